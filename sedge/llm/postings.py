"""Approximate nearest neighbours by balanced posting lists under a graph of centroids.

Balanced k-means on a bounded sample gives the lists' centroids; a navigable graph over
them is searched best first. A vector goes to its nearest list and, near a boundary, to
others that are not farther by more than a ratio and not hidden behind a nearer one. A
query reads the lists within a distance ratio of its nearest, a ratio that is measured
on the sample so that enough of true neighbours lie in the lists it reads, and goes on to
the next lists while these hold fewer rows than it asks for. Equal vectors are one in
the lists, with as many of their ids as a query can ask for. Long lists are dealt into
blocks, short ones that lie side by side are answered for together, and those that many
queries read go to several tasks.

Defined cases: vectors that are null, zero, not finite, or not of the most common length
neither ask nor answer; a row is never its own neighbour, but a repeated row is another's;
ties go to the smaller vec_id, null last; with fewer candidates a query gets them all; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import vectors
from .common import keep, table

LIST_ROWS = 256
#: Centroids, at most: the graph is held in memory.
MOST_LISTS = 4096
REPLICAS = 4
BOUNDARY = 0.05
DEGREE = 16
#: Share of the true neighbours in the sample that the lists a query reads must hold.
TARGET = 0.98
PROBES = 256
BLOCK = 4096
QUERIES_PER_TASK = 1024


@dataclass
class Lists:
    centroids: np.ndarray
    graph: np.ndarray  # centroid, its neighbours
    ratio: float = 0.0

    def search(self, x: np.ndarray, ratio: float, least: int = 1) -> np.ndarray:
        """Distances to the centroids that a best-first search over the graph reaches, infinite to others.

        A search ends when its nearest unvisited centroid is beyond the ratio and ``least`` have been visited.
        """
        n, k = len(x), len(self.centroids)
        found, done = np.full((n, k), np.inf), np.zeros((n, k), bool)
        found[:, 0] = np.sqrt(vectors.squared(x, self.centroids[:1]))[:, 0]
        live = np.arange(n)
        for step in range(k):
            waiting = np.where(done[live], np.inf, found[live])
            best = waiting.argmin(axis=1)
            reach = waiting[np.arange(len(live)), best]
            go = np.isfinite(reach) & ((reach <= (1 + ratio) * found[live].min(axis=1)) | (step < least))
            live, best = live[go], best[go]
            if not len(live):
                break
            done[live, best] = True
            near = self.graph[best]
            c = self.centroids[near]
            d = np.sqrt(np.maximum(((x[live][:, None, :] - c) ** 2).sum(axis=2), 0))
            found[live[:, None], near] = np.minimum(found[live[:, None], near], d)
        return found

    def between(self) -> np.ndarray:
        """Distances between centroids; a task makes them once."""
        return np.sqrt(vectors.squared(self.centroids, self.centroids))

    def homes(self, x: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector, list): the nearest list, and at a boundary others in no nearer chosen one's shadow."""
        d = self.search(x, BOUNDARY, least=2 * DEGREE)
        order = np.argsort(d, axis=1)[:, : 4 * REPLICAS]
        own, lists = [np.arange(len(x))], [order[:, 0]]
        chosen = np.full((len(x), REPLICAS), -1)
        chosen[:, 0], n = order[:, 0], np.ones(len(x), dtype=np.int64)
        for r in range(1, order.shape[1]):
            c = order[:, r]
            dist = d[np.arange(len(x)), c]
            shadow = np.zeros(len(x), bool)
            for s in range(REPLICAS):
                shadow |= (chosen[:, s] >= 0) & (between[c, chosen[:, s]] < dist)
            ok = np.flatnonzero((dist <= (1 + BOUNDARY) * d[np.arange(len(x)), order[:, 0]]) & ~shadow & (n < REPLICAS))
            chosen[ok, n[ok]] = c[ok]
            n[ok] += 1
            own.append(ok)
            lists.append(c[ok])
        return np.concatenate(own), np.concatenate(lists)

    def read(self, x: np.ndarray, held: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, list) of the lists within the ratio, and of the next nearest until ``least`` rows are at home in them.

        ``held`` counts each row once, in its nearest list.
        """
        d = self.search(x, self.ratio, least=2 * DEGREE)
        read = d <= (1 + self.ratio) * d.min(axis=1, keepdims=True)
        few = np.flatnonzero(read @ held < least)
        if len(few):
            order = np.argsort(np.where(read[few], -1.0, vectors.squared(x[few], self.centroids)), axis=1, kind="stable")
            before = np.cumsum(held[order], axis=1) - held[order]
            np.put_along_axis(more := np.zeros((len(few), len(held)), bool), order, before < least, 1)
            read[few] |= more
        return np.nonzero(read)

    def bundles(self, rows: np.ndarray) -> np.ndarray:
        """The bundle of each list: lists side by side share one up to ``BLOCK`` rows; a longer list is one alone.

        Tasks answer for bundles, so that a query's answers from near lists are merged where they are found.
        """
        coarse = vectors.kmeans(self.centroids, max(1, len(rows) // 16))
        side = vectors.squared(self.centroids, coarse).argmin(axis=1)
        out, at, held = np.zeros(len(rows), np.int32), 0, 0
        for i in np.argsort(side, kind="stable").tolist():
            if held and held + rows[i] > BLOCK:
                at, held = at + 1, 0
            out[i] = at
            held += rows[i]
        return out


def navigable(c: np.ndarray) -> np.ndarray:
    """Each centroid's neighbours: nearest first, less those nearer to a chosen one, filled up with the nearest and one random link."""
    k = len(c)
    degree = min(DEGREE, k)
    d = vectors.squared(c, c)
    np.fill_diagonal(d, -1)
    order = np.argsort(d, axis=1, kind="stable")
    rng = np.random.default_rng(vectors.SEED)
    out = np.zeros((k, degree), dtype=np.int64)
    for i in range(k):
        picked: list[int] = []
        for j in order[i, 1 : 4 * degree + 1].tolist():
            if len(picked) < degree // 2 and all(d[j, p] >= d[i, j] for p in picked):
                picked.append(j)
        picked += [j for j in order[i].tolist()[1 : 2 * degree + 1] if j not in picked]
        picked = [*picked[: degree - 1], int(rng.integers(k))]
        out[i] = [*picked, *[i] * (degree - len(picked))]
    return out


def fit(x: np.ndarray, rows: int) -> Lists:
    """Lists for ``rows`` vectors, fitted on the sample ``x``."""
    x = vectors.unit(x)
    k = max(1, min(MOST_LISTS, rows // LIST_ROWS, len(x) // 4))
    c = vectors.kmeans(x, k, balance=0.05)
    lists = Lists(c, navigable(c))
    rng = np.random.default_rng(vectors.SEED)
    asked = rng.choice(len(x), min(PROBES, len(x)), replace=False)
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -np.inf
    near = np.argsort(-s, axis=1)[:, : min(5, len(x) - 1)]
    own, home = lists.homes(x, lists.between())
    d = np.sqrt(vectors.squared(x[asked], c))
    d = d / np.maximum(d.min(axis=1, keepdims=True), 1e-12) - 1
    best = np.full((len(asked), len(x)), np.inf)
    np.minimum.at(best.T, own, d[:, home].T)
    need = np.take_along_axis(best, near, 1).ravel() if near.size else np.zeros(1)
    # Ties at distance 0 leave the ratio undefined; such queries read what the others need.
    lists.ratio = float(np.quantile(np.minimum(need, 10.0), TARGET)) + 1e-9
    return lists


def parts(batches, rows: int = 512):
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def classes_of(rows: DataFrame, k: int) -> DataFrame:
    """(row, vec_id, v, n, members): one row per unlike vector, with its k + 1 members of least id and row, in that order.

    ``row`` and ``vec_id`` are the first member's; no query asks for more than k + 1 of equal vectors.
    Spark cuts each task's part of a group to k + 1 rows before the exchange, so a group of any size ships few.
    """
    key = F.xxhash64("v")
    turn = F.row_number().over(Window.partitionBy("h", "v").orderBy(F.col("vec_id").asc_nulls_last(), "row"))
    few = rows.withColumn("h", key).withColumn("turn", turn).where(F.col("turn") <= k + 1)
    made = few.groupBy("h", "v").agg(F.array_sort(F.collect_list(F.struct("turn", "row", "vec_id"))).alias("members"))
    return made.select(F.col("members")[0]["row"].alias("row"), F.col("members")[0]["vec_id"].alias("vec_id"), "v", F.size("members").alias("n"), "members")


def search(table: DataFrame, asks: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest by cosine of each row for which ``asks`` (over vec_id) holds.

    Equal vectors are searched for, and searched with, once.
    """
    rows = vectors.valid(table)
    if "double" not in rows.schema["v"].dataType.simpleString():
        rows = rows.withColumn("v", F.col("v").cast("array<float>"))
    rows = keep(rows, "vectors")
    kind = rows.schema["v"].dataType.simpleString()
    classes = keep(classes_of(rows, k), "classes")
    n = classes.count()
    spark = table.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], out)
    shared = spark.sparkContext.broadcast(fit(vectors.sample(classes), n))

    def home(batches):
        between = shared.value.between()
        for part in parts(batches):
            own, lists = shared.value.homes(vectors.unit(vectors.matrix(part.column("v"))), between)
            got = part.take(pa.array(own))
            # A row's first list, its nearest, is its home.
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), *got.columns, pa.array(np.arange(len(own)) < len(part))], ["list", *got.schema.names, "home"])

    members = keep(classes.select("row", "vec_id", "v", "n").mapInArrow(home, f"list int, row long, vec_id long, v {kind}, n int, home boolean"), "members")
    held, size = np.zeros((2, len(shared.value.centroids)), dtype=np.int64)
    for r in members.groupBy("list").agg(F.sum(F.when(F.col("home"), F.col("n"))).alias("n"), F.count(F.lit(1)).alias("size")).collect():  # one row per list
        held[r.list], size[r.list] = r.n or 0, r.size
    bundle = shared.value.bundles(size)

    def read(batches):
        for part in parts(batches):
            own, lists = shared.value.read(vectors.unit(vectors.matrix(part.column("v"))), held, k + 1)
            own, bundles = np.unique(np.stack([own, bundle[lists]]), axis=1)
            got = part.take(pa.array(own))
            yield pa.RecordBatch.from_arrays([pa.array(bundles, pa.int32()), *got.columns], ["bundle", *got.schema.names])

    asked_rows = rows.where(asks).withColumn("h", F.xxhash64("v"))
    asked_classes = keep(asked_rows.groupBy("h", "v").agg(F.min("row").alias("row")), "asked")
    asking = asked_rows.join(asked_classes.withColumnRenamed("row", "asked"), ["h", "v"]).select("asked", "row", "vec_id")
    queries = keep(asked_classes.select("row", "v").mapInArrow(read, f"bundle int, row long, v {kind}"), "queries")
    blocks = np.maximum(1, np.ceil(np.bincount(bundle, size) / BLOCK)).astype(int)
    where = spark.createDataFrame([(i, int(b), int(blocks[b])) for i, b in enumerate(bundle)], "list int, bundle int, blocks int")  # one row per list
    asked = keep(queries.groupBy("bundle").agg(F.ceil(F.count(F.lit(1)) / QUERIES_PER_TASK).cast("int").alias("turns")), "turns")
    shape = where.join(asked, "bundle")
    deal = lambda df, own, n, other, m: df.withColumn(own, F.pmod(F.xxhash64("row"), F.col(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(m) - 1)))
    columns = ["bundle", "block", "turn", "query", "row", "vec_id", "v"]
    both = deal(members.join(F.broadcast(shape), "list"), "block", "blocks", "turn", "turns").withColumn("query", F.lit(False)).select(*columns)
    asks_of = deal(queries.join(F.broadcast(shape.drop("list").distinct()), "bundle"), "turn", "turns", "block", "blocks")
    keyed = both.unionByName(asks_of.withColumn("query", F.lit(True)).withColumn("vec_id", F.lit(None).cast("long")).select(*columns))

    def answer(group: pa.Table) -> pa.Table:
        ask = group.column("query").to_numpy()
        row, known = group.column("row").to_numpy(), group.column("vec_id").combine_chunks()
        # Null ids come after all others.
        ids = known.fill_null(np.iinfo(np.int64).max).to_numpy()
        x = vectors.matrix(group.column("v").combine_chunks())
        norm = np.sqrt((x * x).sum(axis=1))
        q, m = np.flatnonzero(ask), np.flatnonzero(~ask)
        m = m[np.unique(row[m], return_index=True)[1]]  # a boundary row may be in several of a bundle's lists
        if len(q) and len(m):
            s = (x[q] / norm[q, None]) @ (x[m] / norm[m, None]).T
            kth = min(k + 1, len(m))
            least = np.partition(s, len(m) - kth, axis=1)[:, len(m) - kth]
            i, j = np.nonzero(s >= least[:, None] - 1e-12)
            a, b = q[i], m[j]
            exact = np.clip((x[a] * x[b]).sum(axis=1) / (norm[a] * norm[b]), -1.0, 1.0)
            order = np.lexsort((row[b], ids[b], -exact, i))
            i = i[order]
            order = order[np.arange(len(i)) - np.searchsorted(i, i) <= k]
            a, b, exact = a[order], b[order], exact[order]
            return pa.table({"asked": row[a], "row": row[b], "vec_id": known.take(pa.array(b)), "score": exact})
        return pa.table({"asked": pa.array([], pa.int64()), "row": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    pairs = keyed.groupBy("bundle", "block", "turn").applyInArrow(answer, "asked long, row long, vec_id long, score double")
    pairs = pairs.groupBy("asked", "row", "vec_id").agg(F.max("score").alias("score"))
    first = lambda df: df.withColumn("turn", F.row_number().over(Window.partitionBy("asked").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row"))).where(F.col("turn") <= k + 1)
    # The k + 1 nearest rows lie in the k + 1 nearest classes: each row before one of a class has that class's first row before it.
    several = classes.where("n > 1").select("row", "members")
    alone = F.array(F.struct(F.lit(1).alias("turn"), "row", "vec_id"))
    near = first(pairs).join(several, "row", "left").select("asked", "score", F.explode(F.coalesce("members", alone)).alias("m"))
    near = first(near.select("asked", "score", "m.row", "m.vec_id"))
    answers = near.groupBy("asked").agg(F.array_sort(F.collect_list(F.struct("turn", "row", "vec_id", "score"))).alias("near"))
    own = asking.select("asked", F.col("row").alias("query_row"), F.col("vec_id").alias("query_id")).join(answers, "asked")
    others = F.slice(F.filter("near", lambda x: x["row"] != F.col("query_row")), 1, k)
    return own.select("query_id", F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES = {"op2_posting_lists": op2}
ORACLES: dict[str, str] = {}
