"""Quotation linking: conversations in reply order, without what they quote.

A line's leading ``>`` marks give its quote level; runs of lines of one level are
passages. A quoted passage is normalised (case, punctuation and white space) and hashed; an
original passage is one of level 0, whole, by paragraph or line by line, and its first message in
the conversation is its origin. A quoted passage of several lines or paragraphs is also held by a
message that says them in this order, with others between or around them; one that no earlier
message holds counts by its single lines and paragraphs. A message replies to the earlier message
that is the origin of a passage it quotes; among several, the shallowest quote level, then the
latest origin, counts. Replies make trees; a message stands after what it replies to, siblings by turn.

Defined cases: a null text is an empty text; messages without a quote that is found reply to none
and stand by turn, null turns first; equal turns are told apart by their row; null
conversation ids form one conversation; quotes are removed whether found or not; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_kept, keep, table

MARK = r"^(?:[ \t]*>)+"


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _hashes(texts: Column) -> Column:
    """Hashes of the normalised texts with a letter or digit, in order."""
    return F.transform(F.filter(F.transform(texts, _normal), lambda t: t != ""), lambda t: F.xxhash64(t))


def messages(table: DataFrame) -> DataFrame:
    """Adds row, lines (level, line) and passages: structs of level and of the hashes of the whole, its lines and its paragraphs."""
    rows = table.select(F.monotonically_increasing_id().alias("row"), "conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    lines = F.transform(F.split("text", "\r?\n"), lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, MARK, 0), "[^>]", "")).alias("level"), F.regexp_replace(x, MARK + r"[ \t]?", "").alias("line")))
    rows = rows.withColumn("lines", lines)
    # A passage begins where the level changes; blank lines part its paragraphs.
    start = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: (i == 0) | (F.get("lines", i)["level"] != F.get("lines", i - 1)["level"]))
    rows = rows.withColumn("_start", start).withColumn("_end", F.concat(F.slice("_start", F.lit(2), F.size("_start")), F.array(F.size("lines"))))
    runs = F.zip_with("_start", "_end", lambda a, b: F.struct(F.get("lines", a)["level"].alias("level"), F.array_join(F.transform(F.slice("lines", a + 1, b - a), lambda x: x["line"]), "\n").alias("body")))
    rows = rows.withColumn("_runs", F.filter(F.transform(runs, lambda p: F.struct(p["level"].alias("level"), p["body"].alias("body"), _normal(p["body"]).alias("said"))), lambda p: p["said"] != ""))
    passage = lambda p: F.struct(p["level"].alias("level"), F.xxhash64(p["said"]).alias("hash"), _hashes(F.split(p["body"], "\n")).alias("single"), _hashes(F.split(p["body"], r"\n[ \t]*(?:\n[ \t]*)+")).alias("paragraphs"))
    return rows.withColumn("passages", F.transform("_runs", passage)).drop("_start", "_end", "_runs")


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_none", F.col("conv_id").isNull()).withColumn("_conv", F.coalesce("conv_id", F.lit(0)))


def _said(rows: DataFrame) -> DataFrame:
    """(_none, _conv, at, hash) of all that messages say: passages, paragraphs and lines of level 0."""
    own = F.filter("passages", lambda p: p["level"] == 0)
    every = F.flatten(F.transform(own, lambda p: F.concat(F.array(p["hash"]), p["paragraphs"], p["single"])))
    return rows.select("_none", "_conv", F.struct("turn", "row").alias("at"), F.explode(F.array_distinct(every)).alias("hash"))


def origins(said: DataFrame) -> DataFrame:
    """The first message of each conversation that says a passage, by the passage's hash, and the number of messages that do."""
    return said.groupBy("_none", "_conv", "hash").agg(F.min("at").alias("origin"), F.count(F.lit(1)).alias("m"))


def _in_order(wanted: Column, held: Column) -> Column:
    """Whether ``held`` has the items of ``wanted`` in this order, with any others between."""
    step = lambda n, x: F.when(F.get(wanted, n) == x, n + 1).otherwise(n)
    return F.aggregate(held, F.lit(0), step) == F.size(wanted)


def holders(rows: DataFrame, quoted: DataFrame, said: DataFrame, first: DataFrame) -> DataFrame:
    """(_none, _conv, run, origin): the first message that says the lines or paragraphs of a quoted passage in order.

    A passage that many quote is looked for once, among the messages that say the rarest of its parts.
    """
    runs = quoted.select("_none", "_conv", "run", F.explode(F.array(F.struct(F.lit(0).alias("way"), F.col("single").alias("parts")), F.struct(F.lit(1).alias("way"), F.col("paragraphs").alias("parts")))).alias("x"))
    runs = keep(runs.select("_none", "_conv", "run", "x.way", "x.parts").where(F.size("parts") > 1).dropDuplicates(["_none", "_conv", "run", "way"]), "runs")
    each = runs.select("_none", "_conv", "run", "way", F.size(F.array_distinct("parts")).alias("n"), F.explode(F.array_distinct("parts")).alias("hash"))
    rarest = each.join(first, ["_none", "_conv", "hash"]).groupBy("_none", "_conv", "run", "way").agg(F.min_by("hash", F.struct("m", "hash")).alias("hash"), F.count(F.lit(1)).alias("k"), F.first("n").alias("n")).where("k = n").drop("k", "n")
    at = rarest.join(said, ["_none", "_conv", "hash"]).select("_none", "_conv", "run", "way", "at", F.col("at.row").alias("row"))
    own = F.filter("passages", lambda p: p["level"] == 0)
    held = rows.select("row", F.flatten(F.transform(own, lambda p: p["single"])).alias("single"), F.flatten(F.transform(own, lambda p: p["paragraphs"])).alias("paragraphs"))
    pairs = at.join(runs, ["_none", "_conv", "run", "way"]).join(held, "row").where(_in_order(F.col("parts"), F.when(F.col("way") == 0, F.col("single")).otherwise(F.col("paragraphs"))))
    return pairs.groupBy("_none", "_conv", "run").agg(F.min("at").alias("origin"))


def linked(table: DataFrame) -> DataFrame:
    """Messages with parent (turn and row of the origin they reply to, or null), the number of quotes, and text without them."""
    rows = keep(_keyed(messages(table)), "messages")
    said = _said(rows)
    first = keep(origins(said), "origins")
    quoted = rows.select("row", "turn", "_none", "_conv", F.posexplode(F.filter("passages", lambda p: p["level"] > 0)).alias("place", "p")).select("row", "turn", "_none", "_conv", "place", "p.*")
    quoted = keep(quoted.withColumn("run", F.xxhash64("single", F.lit(0), "paragraphs")), "quoted")
    # Whole passages by their hash or by their parts in order; parts alone count where no earlier message holds the whole.
    parts = F.transform(F.array_except(F.array_distinct(F.concat("single", "paragraphs")), F.array("hash")), lambda h: F.struct(h.alias("hash"), F.lit(1).alias("rank")))
    looked = quoted.select("row", "turn", "_none", "_conv", "place", "level", F.explode(F.concat(F.array(F.struct("hash", F.lit(0).alias("rank"))), parts)).alias("x")).select("row", "turn", "_none", "_conv", "place", "level", "x.*")
    by_hash = looked.join(first.drop("m"), ["_none", "_conv", "hash"]).select("row", "turn", "place", "level", "rank", "origin")
    by_parts = quoted.join(holders(rows, quoted, said, first), ["_none", "_conv", "run"]).select("row", "turn", "place", "level", F.lit(0).alias("rank"), "origin")
    found = by_hash.unionByName(by_parts).where(F.col("origin") < F.struct("turn", "row"))
    passage = found.groupBy("row", "level", "place").agg(F.min(F.when(F.col("rank") == 0, F.col("origin"))).alias("whole"), F.max("origin").alias("part"))
    # The least level, and of its origins the latest.
    level = passage.groupBy("row", "level").agg(F.max(F.coalesce("whole", "part")).alias("origin"))
    best = level.groupBy("row").agg(F.min_by("origin", "level").alias("parent"))
    bare = F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["line"]), "\n")
    quotes = F.size(F.filter("passages", lambda p: p["level"] > 0)).alias("quotes")
    return rows.join(best, "row", "left").select("row", "_none", "_conv", "conv_id", "turn", "role", "parent", quotes, F.btrim(F.regexp_replace(bare, r"\n{3,}", "\n\n"), F.lit(" \t\r\n")).alias("text"))


def reply_ordered(table: DataFrame) -> DataFrame:
    """Messages with depth (1: replies to none) and reply_order (from 1 in each conversation).

    A message's path holds the places of what it replies to, in turn. Paths double each round, so that
    rounds grow as the logarithm of the deepest nesting of replies.
    """
    rows = keep(linked(table), "linked")
    path = F.array(F.struct("turn", "row"))
    jumps = keep(rows.where("parent is not null").select("row", F.col("parent.row").alias("up"), path.alias("path")), "jumps")
    tops = rows.where("parent is null").select("row", F.lit(None).cast("long").alias("up"), path.alias("path"))
    while not jumps.where("up is not null").isEmpty():
        above = jumps.unionByName(tops).select(F.col("row").alias("up"), F.col("path").alias("above"), F.col("up").alias("next"))
        after = keep(jumps.join(above, "up", "left").select("row", F.col("next").alias("up"), F.when(F.col("above").isNull(), F.col("path")).otherwise(F.concat("above", "path")).alias("path")), "jumps")
        drop_kept(jumps)
        jumps = after
    placed = rows.join(jumps.select("row", "path"), "row", "left").withColumn("path", F.coalesce("path", path))
    # Ranks in a conversation of any size: dealt by ranges of paths, ranked in each, and shifted by the ranges before.
    placed = keep(placed.repartitionByRange("_none", "_conv", "path").withColumn("_range", F.spark_partition_id()), "placed")
    before = Window.partitionBy("_none", "_conv").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = placed.groupBy("_none", "_conv", "_range").count().withColumn("_shift", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    own = Window.partitionBy("_none", "_conv", "_range").orderBy("path")
    ranked = placed.withColumn("_own", F.row_number().over(own)).join(shift, ["_none", "_conv", "_range"])
    return ranked.withColumn("reply_order", F.col("_shift") + F.col("_own")).withColumn("depth", F.size("path"))


def conversations(table: DataFrame) -> DataFrame:
    """One row per conversation: its messages in reply order."""
    one = F.struct("reply_order", "turn", "role", "depth", F.col("parent.turn").alias("reply_to"), "text")
    return reply_ordered(table).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x.dropFields("reply_order")).alias("messages"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reply_ordered(table(spark, sf_dir, "conversations"))
    return rows.select("conv_id", "turn", "role", F.col("reply_order").cast("long").alias("reply_order"), F.col("depth").cast("long").alias("depth"), F.col("parent.turn").cast("long").alias("reply_to"), F.col("quotes").cast("long").alias("quotes"), "text")


QUERIES = {"op1_quotes": op1}
ORACLES: dict[str, str] = {}
