"""Secret scans: patterns, and a battery of randomness tests for tokens that no pattern names.

All in DataFrame functions. Every token of 20 and more characters beside the patterns' spans is
tested against the alphabet that its encoding implies: chi-squared over the alphabet and over
classes of its characters, runs about the middle, and serial correlation. The least p-value,
as a level of -10 log10 p, says how far a token is from random.

What is reported is controlled against ordinary text: for each family of tokens that there are
(encoding and class of length) each document gives one decoy, a stretch of its own characters in
the alphabet and at the least length of the family. A token's chance to be ordinary text is the share of its family's decoys that look as
random as it does; Benjamini-Hochberg over these chances, family by family, bounds the expected
share of ordinary text among the spans of kind ``random``. With fewer than about a hundred
documents nothing can be bounded, and nothing is reported.

Defined cases: a null text is an empty text, without spans; positions count code points,
ends are exclusive; repeated rows and ids each give their row; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, shielded, table

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Whole runs at their least length are the same matches as any run with a later test of its length.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
HINTS = ("passw", "secret", "token", "apikey", "api_key")
MASK = "[SECRET]"
#: Expected share of ordinary text among the tokens that are reported, at most.
FDR = 0.01
#: Levels of -10 log10 p; a token beyond the second is not random, whatever the decoys say.
LEVELS, MOST_LEVEL = 300, 30
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
VOWELS, COMMON = "aeiou", "nrstldhc"
RARE = "".join(c for c in LOWER if c not in VOWELS + COMMON)
#: Encoding, pattern, and its alphabet by classes of characters, so that each class is expected often enough; the first that fits is taken.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", (DIGITS, "ae", "bcdf")),
    ("HEX", "^[0-9A-F]+$", (DIGITS, "AE", "BCDF")),
    ("base32", "^[A-Z2-7]+$", ("234567", VOWELS.upper(), COMMON.upper(), RARE.upper())),
    ("base36", "^[0-9a-z]+$", (DIGITS, VOWELS, COMMON, RARE)),
    ("BASE36", "^[0-9A-Z]+$", (DIGITS, VOWELS.upper(), COMMON.upper(), RARE.upper())),
    ("base62", "^[0-9A-Za-z]+$", (DIGITS, UPPER, VOWELS + "lnrst", "".join(c for c in LOWER if c not in VOWELS + "lnrst"))),
    ("base64", "^[0-9A-Za-z+/_-]+$", (DIGITS + "+/-_", UPPER, VOWELS + "lnrst", "".join(c for c in LOWER if c not in VOWELS + "lnrst"))),
)
LENGTHS = (20, 32, 64)
#: Matches of a text whose positions are added up at a time.
RUN = 64
SPAN = "array<struct<start:long,end:long,kind:string>>"


def matches(text: Column, pattern: str) -> Column:
    """Structs of start, end and match, leftmost first: gaps and matches in turn give the positions.

    Positions are added up within runs of matches, then over runs, so that many matches stay cheap.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(found, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda m, gap: F.struct(m.alias("m"), F.length(gap).cast("long").alias("gap")))
    empty = F.array().cast("array<struct<start:long,end:long,m:string>>")

    def placed(run: Column) -> Column:
        def step(a: Column, p: Column) -> Column:
            start = a["at"] + p["gap"]
            end = start + F.length(p["m"])
            return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(start.alias("start"), end.alias("end"), p["m"].alias("m")))).alias("out"))

        return F.aggregate(run, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")), step)

    def cut(all_: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / RUN).cast("int"))
        return F.when(F.size(all_) > 0, F.transform(runs, lambda r: placed(F.slice(all_, r * RUN + 1, F.lit(RUN)))))

    def joined(runs: Column) -> Column:
        start = F.array(F.lit(0).cast("long"))
        starts = F.aggregate(runs, start, lambda a, r: F.concat(a, F.array(F.element_at(a, -1) + r["at"])))
        moved = lambda r, at: F.transform(r["out"], lambda x: F.struct((x["start"] + at).alias("start"), (x["end"] + at).alias("end"), x["m"].alias("m")))
        return F.flatten(F.zip_with(runs, F.slice(starts, F.lit(1), F.size(runs)), moved))

    return F.coalesce(let(let(pairs, cut), joined), empty)


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"))).cast(SPAN)


def upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal (Abramowitz and Stegun 26.2.17)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    p = F.exp(-a * a / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, p).otherwise(1 - p)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed, and written into the plan, once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _counts(token: Column, character: Column) -> Column:
    return (F.length(token) - F.length(F.replace(token, character, F.lit("")))).cast("double")


def battery(token: Column, classes: Column) -> Column:
    """The least of four tests' p-values times four: small where a token isn't random in its alphabet, given by classes of characters."""
    add = lambda a, x: a + x

    def prepared(t: Column) -> Column:
        letters = F.split(t["alphabet"], "")
        values = F.transform(F.split(t["token"], ""), lambda c: F.instr(t["alphabet"], c).cast("double") - 1)
        return F.struct(t["token"].alias("token"), t["classes"].alias("classes"), F.transform(letters, lambda c: _counts(t["token"], c)).alias("counts"), F.size(letters).cast("double").alias("k"), values.alias("values"), F.length(t["token"]).cast("double").alias("n"))

    def paired(s: Column) -> Column:
        v = s["values"]
        pairs = F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        mean = F.aggregate(v, F.lit(0.0), add) / s["n"]
        return F.struct(s.alias("s"), pairs.alias("pairs"), mean.alias("mean"))

    def facts(x: Column) -> Column:
        s, pairs, mean = x["s"], x["pairs"], x["mean"]
        k, n, values = s["k"], s["n"], s["values"]
        middle = (k - 1) / 2
        spread = (F.aggregate(s["counts"], F.lit(0.0), lambda a, c: a + c * c) * k / n - n) / (k - 1)  # chi-squared over its degrees of freedom
        shares = F.transform(s["classes"], lambda c: F.struct((n * F.length(c) / k).alias("want"), (n - F.length(F.call_function("translate", s["token"], c, F.lit("")))).alias("got")))
        by_class = F.aggregate(shares, F.lit(0.0), lambda a, c: a + (c["got"] - c["want"]) * (c["got"] - c["want"]) / c["want"])
        high = F.size(F.filter(values, lambda v: v > middle)).cast("double")
        runs = 1.0 + F.size(F.filter(pairs, lambda p: (p["a"] > middle) != (p["b"] > middle)))
        total = F.aggregate(values, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
        cross = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + (p["a"] - mean) * (p["b"] - mean))
        return F.struct(
            spread.alias("spread"), (2 / (9 * (k - 1))).alias("v"), by_class.alias("by_class"), F.size(s["classes"]).alias("n_classes"),
            runs.alias("runs"), (2 * high * (n - high) / n + 1).alias("want"), total.alias("total"), cross.alias("cross"), n.alias("n"),
        )

    def scores(f: Column) -> Column:
        never, tail = F.lit(float("inf")), lambda z: F.when(z > 37, F.lit(1e-300)).otherwise(upper_tail(z))
        var = (f["want"] - 1) * (f["want"] - 2) / (f["n"] - 1)
        x = f["by_class"]
        # Chi-squared's tails of two and of three degrees of freedom.
        two, three = F.exp(-x / 2), 2 * tail(F.sqrt(x)) + F.sqrt(2 * x / F.lit(3.141592653589793)) * F.exp(-x / 2)
        p = F.array(
            tail((F.pow(f["spread"], F.lit(1 / 3)) - (1 - f["v"])) / F.sqrt(f["v"])),
            F.when(f["n_classes"] == 3, two).otherwise(three),
            2 * tail(F.when(var > 0, F.abs((f["runs"] - f["want"]) / F.sqrt(var))).otherwise(never)),
            2 * tail(F.when(f["total"] > 0, F.abs((f["cross"] / f["total"] + 1 / f["n"]) * F.sqrt(f["n"]))).otherwise(never)),
        )
        return F.least(F.lit(1.0), 4 * F.array_min(p))

    given = F.struct(token.alias("token"), classes.alias("classes"), F.array_join(F.array_sort(F.split(F.array_join(classes, ""), "")), "").alias("alphabet"))
    return let(let(let(let(given, prepared), paired), facts), scores)


def _level(token: Column, classes: Column) -> Column:
    return F.least(F.lit(LEVELS), F.floor(-10 * F.log10(F.greatest(battery(token, classes), F.lit(1e-300))))).cast("int")


def _tested(token: Column) -> Column:
    """Family and level of a token; null where it has no 20 characters of an encoding."""

    def of(body: Column) -> Column:
        size = F.length(body)
        length = F.when(size >= LENGTHS[2], LENGTHS[2]).when(size >= LENGTHS[1], LENGTHS[1]).otherwise(LENGTHS[0])
        encoding = F.coalesce(*[F.when(body.rlike(pattern), F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, classes)).alias("classes"))) for name, pattern, classes in ENCODINGS])
        scored = lambda e: F.struct(F.concat_ws(":", e["name"], length.cast("string")).alias("family"), _level(body, e["classes"]).alias("level"))
        return F.when(size >= LENGTHS[0], let(encoding, scored))

    return let(F.regexp_replace(token, "=+$", ""), of)


def decoy(text: Column, name: str, length: int, seed: Column) -> Column:
    """Characters of ``text`` in an encoding's alphabet, of a length, from a seeded place; null where there are too few."""
    pattern = next(p for n, p, _ in ENCODINGS if n == name)
    cased = {"hex": F.lower, "base36": F.lower, "HEX": F.upper, "base32": F.upper, "BASE36": F.upper}.get(name, F.initcap)(text)
    cased = F.regexp_replace(cased, r"[\x20\x09-\x0D]+", "_") if name == "base64" else cased
    kept = F.regexp_replace(cased, pattern.replace("^[", "[^")[:-2], "")
    room = lambda k: F.when(F.length(k) >= length, F.substring(k, (F.pmod(seed, F.length(k) - length + 1) + 1).cast("int"), F.lit(length)))
    return let(kept, room)


def scanned(docs: DataFrame) -> DataFrame:
    """Adds _base (spans of the patterns, by start and kind as listed) and _tokens (tested candidates beside them)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    low = F.lower(text)
    hinted = F.reduce(F.array(*[F.contains(low, F.lit(h)) for h in HINTS]), F.lit(False), lambda a, b: a | b)
    none = F.array().cast("array<struct<start:long,end:long,m:string>>")
    assign = F.filter(F.when(hinted, matches(text, ASSIGN)).otherwise(none), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 8)
    access = F.when(F.contains(text, F.lit("AKIA")), matches(text, ACCESS)).otherwise(none)
    hexes = F.when(text.rlike(HEX), matches(text, HEX)).otherwise(none)
    tokens = F.when(text.rlike(TOKEN), matches(text, TOKEN)).otherwise(none)
    rank = lambda x: F.when(x["kind"] == "assign", 0).when(x["kind"] == "access", 1).otherwise(2)
    docs = docs.withColumns({"_assign": _spans(assign, "assign"), "_access": _spans(access, "access"), "_hex": _spans(hexes, "hex"), "_tokens": tokens})
    keyed = F.transform(F.concat("_assign", "_access", "_hex"), lambda x: F.struct(x["start"].alias("start"), rank(x).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))
    docs = docs.withColumn("_base", F.transform(F.array_sort(keyed), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    free = F.filter("_tokens", lambda t: ~F.exists("_base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    tested = F.filter(F.transform(free, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), _tested(t["m"]).alias("test"))), lambda t: t["test"].isNotNull())
    return docs.withColumn("_tokens", tested).drop("_assign", "_access", "_hex")


def decoy_levels(docs: DataFrame, families: list[str]) -> DataFrame:
    """(family, level, n) of the documents' decoys, one of each document for each family."""
    text, seed = F.coalesce(F.col("text"), F.lit("")), F.xxhash64("doc_id", "text")
    made = []
    for f in families:
        name, length = f.split(":")
        classes = F.array(*map(F.lit, next(c for n, _, c in ENCODINGS if n == name)))
        made.append(F.struct(F.lit(f).alias("family"), decoy(text, name, int(length), seed).alias("token"), classes.alias("classes")))
    rows = docs.select(F.explode(F.filter(F.array(*made), lambda x: x["token"].isNotNull())).alias("d"))
    return rows.select("d.family", _level(F.col("d.token"), F.col("d.classes")).alias("level")).groupBy("family", "level").agg(F.count(F.lit(1)).alias("n"))


def report_levels(found: DataFrame, docs: DataFrame) -> dict[str, int]:
    """By family, the greatest level that is reported: Benjamini-Hochberg over the tokens' shares of decoys.

    At most one row per encoding, class of length and level comes to the driver.
    """
    counts = found.select(F.explode("_tokens.test").alias("t")).groupBy("t.family", "t.level").agg(F.count(F.lit(1)).alias("n")).collect()
    families = sorted({r.family for r in counts})
    if not families:
        return {}
    tokens, decoys = ({f: [0] * (LEVELS + 1) for f in families} for _ in range(2))
    for into, rows in ((tokens, counts), (decoys, decoy_levels(docs, families).collect())):
        for r in rows:
            into[r.family][r.level] += r.n
    return {f: v for f in families if (v := _greatest_reported(tokens[f], decoys[f])) is not None}


def _greatest_reported(tokens: list[int], decoys: list[int]) -> int | None:
    """The greatest level v up to MOST_LEVEL at which all tokens times the share of decoys up to v is at most FDR times the tokens up to v."""
    out, seen, looked = None, 0, 0
    for v in range(MOST_LEVEL + 1):
        seen, looked = seen + tokens[v], looked + decoys[v]
        if seen and sum(tokens) * (looked + 1) / (sum(decoys) + 1) <= FDR * seen:
            out = v
    return out


def with_spans(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds _spans: the base spans and the tokens that are reported as random, by start, kinds as listed; ``docs`` has the texts."""
    most = report_levels(found, docs)
    limit = F.create_map(*[F.lit(x) for kv in most.items() for x in kv]) if most else F.create_map().cast("map<string,int>")
    passed = F.filter("_tokens", lambda t: t["test"]["level"] <= F.coalesce(F.try_element_at(limit, t["test"]["family"]), F.lit(-1)))
    rank = lambda x: F.when(x["kind"] == "assign", 0).when(x["kind"] == "access", 1).otherwise(2)
    base = F.transform("_base", lambda x: F.struct(x["start"].alias("start"), rank(x).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))
    more = F.transform(passed, lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("rank"), t["end"].alias("end"), F.lit("random").alias("kind")))
    # Tokens never overlap base spans, so that starts alone put them in order.
    return found.withColumn("_spans", F.array_sort(F.concat(base, more)))


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


@shielded
def redacted(docs: DataFrame) -> DataFrame:
    """Documents with every span, overlapping ones as one, replaced by a mark; n_chars follows."""
    columns = docs.columns
    found = with_spans(keep(scanned(docs), "secrets"), docs)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    cut = lambda a, b: F.substring("text", (a + 1).cast("int"), (b - a).cast("int"))
    step = lambda a, x: F.when(x["start"] >= a["at"], F.struct(x["end"].alias("at"), F.concat(a["out"], F.array(cut(a["at"], x["start"]), F.lit(MASK))).alias("out"))).otherwise(F.struct(F.greatest(a["at"], x["end"]).alias("at"), a["out"].alias("out")))
    ended = F.aggregate("_spans", start, step, lambda a: F.array_join(F.concat(a["out"], F.array(cut(a["at"], F.length("text").cast("long")))), ""))
    out = found.withColumn("text", F.when(F.size("_spans") > 0, ended).otherwise(F.col("text")))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.size("_spans") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*columns)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_spans(keep(scanned(docs).drop("text"), "secrets"), docs)
    count = lambda kind: F.size(F.filter("_base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined("_base"), 256).alias("base_sha256"), _joined("_spans").alias("spans"))


QUERIES = {"op10_secrets": op10}
ORACLES = {}
