"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

All in DataFrame functions. Sources get targets by weight, capped at twice their
size, with the excess reshared. The mix's blocks go to sources, and each source's
blocks to its shards, by highest quotients votes / (2 k + 1). Within a shard,
documents stand in a seeded order, their words form one stream cut into blocks,
and a seeded choice of blocks fills the shard's quota.

Defined cases: null or empty texts have size 0 and are taken 0 times; a null source
is a source of its own, last in order; repeated rows are rows of their own; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, keep, shielded, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5  # of all words
MOST = 2  # times a document's or source's size
BLOCK_WORDS = 64
SHARD_WORDS = 1 << 18
SEED = "mix"


def _seeded(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, idx, source_size, target): one row per source; ``sizes`` has source and size.

    A source reaches its cap when its cap per weight is at most the level to which
    the rest would fill; sources in order of that ratio reach theirs first.
    """
    every = Window.partitionBy(F.lit(0))
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("idx", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), F.pmod("idx", F.lit(len(WEIGHTS))) + 1)
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * MOST)
    fill = every.orderBy(F.col("cap") / F.col("weight"), "idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = per.select(
        "*",
        ((F.sum("source_size").over(every) * SHARE) - (F.sum("cap").over(fill) - F.col("cap"))).alias("left"),
        (F.sum("weight").over(every) - F.sum("weight").over(fill) + F.col("weight")).alias("heads"),
    ).withColumn("level", F.col("left") / F.col("heads"))
    full = F.col("cap") / F.col("weight") <= F.col("level")
    open_level = F.max(F.when(~full, F.col("level"))).over(every)
    return per.select("source", "idx", "source_size", F.when(full, F.col("cap").cast("double")).otherwise(open_level * F.col("weight")).alias("target"))


def apportion(df: DataFrame, votes: str, seats: Column, group: list[str], order: list[str]) -> DataFrame:
    """Adds ``quota``: integer seats by Sainte-Laguë within each group; ``seats`` is the same for all rows of a group.

    The seats of all but about one quotient per row follow from a bound on the last winning
    quotient, so that only a few candidates per row are ranked. Ties go to the first in ``order``.
    """
    g = Window.partitionBy(*[F.col(c) for c in group]) if group else Window.partitionBy(F.lit(0))
    df = df.select("*", F.sum(votes).over(g).cast("double").alias("_all"), F.sum((F.col(votes) > 0).cast("long")).over(g).alias("_n"), seats.cast("long").alias("_seats"))
    over = 2 * F.col("_seats") - F.col("_n")
    at = lambda q: F.floor((F.col(votes) / q + 1) / 2)
    low = F.when((F.col("_all") > 0) & (over > 0), F.greatest(at(F.col("_all") / over) - 1, F.lit(0))).otherwise(F.lit(0)).cast("long")
    high = F.when((F.col("_all") > 0) & (F.col("_seats") > 0), at(F.col("_all") / (2 * F.col("_seats") + F.col("_n"))) + 1).otherwise(F.lit(0)).cast("long")
    df = df.select("*", low.alias("_low"), high.alias("_high")).withColumn("_rest", F.col("_seats") - F.sum("_low").over(g))
    key = [*group, *[c for c in order if c not in group]]
    tries = df.where(F.col("_high") > F.col("_low")).select(*key, votes, "_rest", F.explode(F.sequence(F.col("_low"), F.col("_high") - 1)).alias("_k"))
    ranked = tries.withColumn("_rank", F.row_number().over(g.orderBy((F.col(votes) / (2 * F.col("_k") + 1)).desc(), *order, "_k")))
    won = ranked.where("_rank <= _rest").groupBy(*key).agg(F.count(F.lit(1)).alias("_won"))
    return df.join(won, key, "left").withColumn("quota", F.col("_low") + F.coalesce("_won", F.lit(0))).drop("_all", "_n", "_seats", "_low", "_high", "_rest", "_won")


def sized(docs: DataFrame) -> DataFrame:
    """Row number, id, source and size of each document. Row numbers are those of the scan."""
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def mix(sizes: DataFrame, pieces: bool = False) -> DataFrame:
    """(row, doc_id, size, source_size, target, taken) of ``sized`` documents.

    With ``pieces``, also what is taken of each: structs of first word, words and times.
    """
    targets = source_targets(sizes).withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS)).cast("long"))
    all_words = F.sum("target").over(Window.partitionBy(F.lit(0)))
    targets = apportion(targets, "target", F.round(all_words / BLOCK_WORDS), [], ["idx"]).withColumnRenamed("quota", "source_quota")
    docs = sizes.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left")
    docs = docs.withColumn("shard", F.pmod(F.conv(F.substring(_seeded(F.col("doc_id")), 1, 8), 16, 10).cast("long"), F.col("shards")))
    shards = docs.groupBy("idx", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota"))
    shards = apportion(shards, "shard_size", F.col("source_quota"), ["idx"], ["shard"])
    shards = shards.withColumn("blocks", F.ceil(F.col("shard_size") / BLOCK_WORDS).cast("long")).where("blocks > 0")
    shards = shards.withColumn("quota", F.least(F.col("quota"), F.col("blocks") * MOST))
    # A shard has some 4,000 blocks: their list is made where the shard is dealt to, never where AQE would put a few small rows together.
    shards = shards.repartition(int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions")), "idx", "shard")
    chosen = shards.select("idx", "shard", F.floor(F.col("quota") / F.col("blocks")).alias("every"), F.pmod("quota", F.col("blocks")).alias("extra"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    seeded = Window.partitionBy("idx", "shard").orderBy(_seeded(F.col("idx"), F.col("shard"), F.col("block")), "block")
    chosen = chosen.select("idx", "shard", "block", (F.col("every") + (F.row_number().over(seeded) <= F.col("extra")).cast("long")).alias("times"))
    stream = Window.partitionBy("idx", "shard").orderBy(_seeded(F.col("doc_id"), F.lit("order")), "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = docs.withColumn("end", F.sum("size").over(stream)).withColumn("start", F.col("end") - F.col("size"))
    first, last = F.floor(F.col("start") / BLOCK_WORDS), F.floor((F.col("end") - 1) / BLOCK_WORDS)
    kept = ["row", "doc_id", "size", "source_size", "target"]
    parts = placed.select(*kept, "idx", "shard", "start", "end", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))).alias("block"))
    parts = parts.join(chosen.hint("merge"), ["idx", "shard", "block"], "left")  # the list of blocks grows with the words: never broadcast
    at = F.greatest(F.col("start"), F.col("block") * BLOCK_WORDS)
    n = F.least(F.col("end"), (F.col("block") + 1) * BLOCK_WORDS) - at
    parts = parts.select(*kept, (at - F.col("start")).alias("at"), n.alias("n"), F.coalesce("times", F.lit(0)).cast("long").alias("times"))
    more = [F.array_sort(F.collect_list(F.when(F.col("times") > 0, F.struct("at", "n", "times")))).alias("pieces")] if pieces else []
    return parts.groupBy(*kept).agg(F.coalesce(F.sum(F.col("n") * F.col("times")), F.lit(0)).cast("long").alias("taken"), *more)


@shielded
def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each time a document is used.

    Its text is the taken words of that time, joined by spaces, or the text as it was where all are taken.
    """
    columns = docs.columns
    plan = mix(keep(sized(docs), "sizes"), pieces=True).where("taken > 0").select(F.col("row").alias("_row"), F.col("size").alias("_size"), F.col("pieces").alias("_pieces"))
    rows = docs.withColumn("_id", F.monotonically_increasing_id()).join(plan, F.col("_id") == F.col("_row"))
    rows = rows.withColumn("_time", F.explode(F.sequence(F.lit(1), F.array_max(F.transform("_pieces", lambda p: p["times"])).cast("int"))))
    used = F.filter("_pieces", lambda p: p["times"] >= F.col("_time"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    cut = F.array_join(F.flatten(F.transform(used, lambda p: F.slice(words, (p["at"] + 1).cast("int"), p["n"].cast("int")))), " ")
    whole = F.aggregate(used, F.lit(0).cast("long"), lambda a, p: a + p["n"]) == F.col("_size")
    rows = rows.withColumn("text", F.when(whole, F.col("text")).otherwise(cut))
    if "n_chars" in columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*columns)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(keep(sized(table(spark, sf_dir, "documents")), "sizes")).drop("row")


QUERIES = {"op5_mixing": op5}
ORACLES = {
    "op5_mixing": r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, row_number() OVER () AS r FROM documents),
p0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
p1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS idx FROM p0),
p2 AS (SELECT *, [3, 1, 2][idx % 3 + 1] AS w, 2 * source_size AS cap FROM p1),
p3 AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - (sum(cap) OVER o - cap)) / (sum(w) OVER () - sum(w) OVER o + w)::DOUBLE AS lvl
       FROM p2 WINDOW o AS (ORDER BY cap::DOUBLE / w, idx ROWS UNBOUNDED PRECEDING)),
p4 AS (SELECT *, cap::DOUBLE / w <= lvl AS sat FROM p3),
p5 AS (SELECT *, CASE WHEN sat THEN cap::DOUBLE ELSE max(CASE WHEN NOT sat THEN lvl END) OVER () * w END AS target FROM p4),
n0 AS (SELECT CAST(round(sum(target) / 64) AS BIGINT) AS seats FROM p5),
q0 AS (SELECT idx, target / (2 * k + 1) AS q, k FROM p5, n0, LATERAL (SELECT unnest(range(CAST(ceil(target / 64) AS BIGINT) + 3)) AS k)),
q1 AS (SELECT idx, row_number() OVER (ORDER BY q DESC, idx, k) AS rk FROM q0),
q2 AS (SELECT idx, count(*) AS quota FROM q1, n0 WHERE rk <= seats GROUP BY idx),
s AS (SELECT p5.*, coalesce(quota, 0) AS quota, greatest(1, CAST(ceil(source_size / 262144.0) AS BIGINT)) AS shards FROM p5 LEFT JOIN q2 USING (idx)),
e AS (SELECT d.*, s.idx, s.source_size, s.target, ('0x' || substr(md5('mix|' || doc_id), 1, 8))::BIGINT % s.shards AS shard FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
h AS (SELECT e.idx, e.shard, sum(size) AS ssize FROM e GROUP BY ALL),
h1 AS (SELECT h.idx, h.shard, h.ssize, s.quota AS sq, h.ssize / (2 * k + 1) AS q, k FROM h JOIN s USING (idx), LATERAL (SELECT unnest(range(CAST(s.quota AS BIGINT) + 1)) AS k)),
h2 AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY q DESC, shard, k) AS rk FROM h1 WHERE ssize > 0),
h3 AS (SELECT idx, shard, any_value(ssize) AS ssize, CAST(ceil(any_value(ssize) / 64.0) AS BIGINT) AS nb, count(*) FILTER (WHERE rk <= sq) AS quota FROM h2 GROUP BY ALL),
b AS (SELECT idx, shard, least(quota, 2 * nb) AS quota, nb, unnest(range(nb)) AS block FROM h3),
b1 AS (SELECT idx, shard, block, quota // nb + CASE WHEN row_number() OVER (PARTITION BY idx, shard ORDER BY md5('mix|' || idx || '|' || shard || '|' || block), block) <= quota % nb THEN 1 ELSE 0 END AS times FROM b),
f AS (SELECT *, sum(size) OVER (PARTITION BY idx, shard ORDER BY md5('mix|' || doc_id || '|order'), doc_id, size, r ROWS UNBOUNDED PRECEDING) AS fin FROM e),
g AS (SELECT *, fin - size AS start FROM f),
t AS (SELECT g.r, sum((least(g.fin, (b1.block + 1) * 64) - greatest(g.start, b1.block * 64)) * b1.times) AS taken
      FROM g JOIN b1 ON g.idx = b1.idx AND g.shard = b1.shard AND b1.block >= g.start // 64 AND b1.block <= (g.fin - 1) // 64 WHERE g.size > 0 GROUP BY g.r)
SELECT g.doc_id, g.size, g.source_size, g.target, CAST(coalesce(t.taken, 0) AS BIGINT) AS taken FROM g LEFT JOIN t USING (r)
"""
}
