"""Near-duplicate vectors by an inverted multi-index.

Two codebooks, one for each half of the unit vectors, form a grid of cells. From a
vector, a multi-sequence traversal visits cells by rising sum of the two halves' squared
distances and stops where the target recall is reached: at a radius beyond the vector's
own cell within which lie the cells of that share of its partners. The radius is measured
on partners at exactly the threshold cosine, drawn around sample vectors, and on the
sample's real links; the larger one holds. All vectors of visited cells are verified.

Zones, groups of left codewords by groups of right ones, deal the grid out to tasks: each
runs the traversal over its own part. Equal vectors are one vector with a count of copies.

Defined cases: vectors that are null, zero, not finite, or not of the most common length
link with nothing and are their own component; a repeated row is a vector of its own; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectors
from .common import keep, table
from .components import components

LEAST = 0.9
#: Share of threshold partners whose cells are visited, from one of two sides.
TARGET = 0.99
CELL_ROWS = 16
MOST_CODES = 256
ZONE_ROWS = 4096
MOST_ZONES = 64
#: Groups of right codewords, at most; more than one once ``MOST_ZONES`` groups of left ones hold too many rows.
MOST_RIGHT_ZONES = 256
TASK_ROWS = 4096
PARTNERS = 2000
#: Classes of equal vectors that hold at least one in so many rows are joined by broadcast, so many at most.
HOT = 256


@dataclass
class Grid:
    left: np.ndarray
    right: np.ndarray
    left_zone: np.ndarray  # of each left codeword, from 0 without gaps
    right_zone: np.ndarray
    radius: float = 0.0

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = x.shape[1] // 2
        return vectors.squared(x[:, :h], self.left), vectors.squared(x[:, h:], self.right)

    def cell(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return a.argmin(axis=1), b.argmin(axis=1)

    def limit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a.min(axis=1) + b.min(axis=1) + self.radius

    @property
    def right_zones(self) -> int:
        return int(self.right_zone.max()) + 1

    @property
    def zones(self) -> int:
        return (int(self.left_zone.max()) + 1) * self.right_zones

    def zone(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self.left_zone[i] * self.right_zones + self.right_zone[j]

    def reached(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """(vector, zone): whether the zone's nearest cell lies within the vector's limit."""
        near = least_of(a, self.left_zone)[:, :, None] + least_of(b, self.right_zone)[:, None, :]
        return near.reshape(len(a), -1) <= self.limit(a, b)[:, None] + 1e-12


def least_of(d: np.ndarray, zone: np.ndarray) -> np.ndarray:
    """The least distance of every row to each zone's codewords."""
    order = np.argsort(zone, kind="stable")
    return np.minimum.reduceat(d[:, order], np.searchsorted(zone[order], np.arange(zone.max() + 1)), axis=1)


def multi_sequence(a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Traverse the cells of many vectors side by side.

    Each step gives (vectors, left codewords, right codewords): the nearest cell not yet visited of every vector
    that has one with a sum of ``a`` and ``b`` up to its ``limit``. A left codeword's next cell is that of the
    nearest right codeword it hasn't met; the least of these is the vector's next.
    """
    who = np.arange(len(a))
    order = np.argsort(b, axis=1, kind="stable")
    rising = np.concatenate([np.take_along_axis(b, order, axis=1), np.full((len(b), 1), np.inf)], axis=1)
    met = np.zeros(a.shape, np.int64)
    front = a + rising[:, :1]
    while len(who):
        i = front.argmin(axis=1)
        go = np.flatnonzero(front[np.arange(len(who)), i] <= limit)
        if 2 * len(go) < len(who):
            who, a, limit, order, rising, met, front = (x[go] for x in (who, a, limit, order, rising, met, front))
            continue
        i = i[go]
        at = met[go, i]
        yield who[go], i, order[go, at]
        met[go, i] = at + 1
        front[go, i] = a[go, i] + rising[go, at + 1]


def fit(x: np.ndarray, rows: int, least: float = LEAST) -> Grid:
    x = vectors.unit(x)
    h = x.shape[1] // 2
    k = int(np.clip(np.sqrt(rows / CELL_ROWS), 1, MOST_CODES))
    left, right = vectors.kmeans(x[:, :h], k), vectors.kmeans(x[:, h:], k)
    zones = int(np.clip(-(-rows // ZONE_ROWS), 1, min(MOST_ZONES, len(left))))
    across = int(np.clip(-(-rows // (ZONE_ROWS * zones)), 1, min(MOST_RIGHT_ZONES, len(right))))
    zoned = lambda c, n: np.unique(vectors.squared(c, vectors.kmeans(c, n)).argmin(axis=1), return_inverse=True)[1]
    grid = Grid(left, right, zoned(left, zones), zoned(right, across))
    rng = np.random.default_rng(vectors.SEED)
    at = x[rng.choice(len(x), min(PARTNERS, len(x)), replace=False)]
    off = rng.normal(size=at.shape)
    off = off - (off * at).sum(axis=1, keepdims=True) * at
    partner = least * at + np.sqrt(1 - least**2) * off / np.maximum(np.linalg.norm(off, axis=1, keepdims=True), 1e-12)
    a, b = grid.halves(at)
    i, j = grid.cell(*grid.halves(partner))
    r = np.arange(len(at))
    own = a.min(axis=1) + b.min(axis=1)
    grid.radius = float(np.quantile(a[r, i] + b[r, j] - own, TARGET)) + 1e-9
    beyond = []
    for s in range(0, len(x), 1024):
        part = x[s : s + 1024]
        p, m = np.nonzero(at @ part.T >= least)
        i, j = grid.cell(*grid.halves(part))
        beyond.append((a[p, i[m]] + b[p, j[m]] - own[p])[(at[p] != part[m]).any(axis=1)])
    beyond = np.concatenate(beyond)
    if len(beyond):
        grid.radius = max(grid.radius, float(np.quantile(beyond, TARGET)) + 1e-9)
    return grid


def links(rows: DataFrame, grid: Grid, least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """(row, n_links) and links (a, b) that connect what the verified pairs connect, each task's as a forest.

    ``rows`` are unlike vectors (row, copies, v); n_links counts the copies of the others.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(grid)
    kind = rows.schema["v"].dataType.simpleString()

    def deal(batches):
        g = shared.value
        for batch in batches:
            size = max(16, min(1024, (1 << 22) // g.zones))
            for s in range(0, batch.num_rows, size):
                part = batch.slice(s, size)
                x = vectors.unit(vectors.matrix(part.column("v")))
                a, b = g.halves(x)
                own = g.zone(*g.cell(a, b))
                i, z = np.nonzero(g.reached(a, b))
                got = part.take(pa.array(np.concatenate([np.arange(len(x)), i])))
                member = np.arange(len(x) + len(i)) < len(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([own, z]), pa.int32()), pa.array(member), *got.columns], ["zone", "member", *got.schema.names])

    dealt = keep(rows.select("row", "copies", "v").mapInArrow(deal, f"zone int, member boolean, row long, copies long, v {kind}"), "zones")
    tasks = lambda m, name: dealt.where(F.col("member") == m).groupBy("zone").agg(F.ceil(F.count(F.lit(1)) / TASK_ROWS).cast("int").alias(name))
    shape = keep(tasks(True, "blocks").join(tasks(False, "turns"), "zone"), "shape")
    hashed = lambda n: F.pmod(F.xxhash64("row", "zone"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sides = [dealt.where(F.col("member") == m).join(shape, "zone").withColumn(own, hashed(n)).withColumn(other, every(o)) for m, own, n, other, o in ((True, "block", "blocks", "turn", "turns"), (False, "turn", "turns", "block", "blocks"))]
    keyed = sides[0].unionByName(sides[1]).select("zone", "block", "turn", "member", "row", "copies", "v")

    def verify(group: pa.Table) -> pa.Table:
        g = shared.value
        member, row, copies = (group.column(c).to_numpy(zero_copy_only=False) for c in ("member", "row", "copies"))
        raw = vectors.matrix(group.column("v").combine_chunks())
        x = vectors.unit(raw)
        a, b = g.halves(x)
        limit = g.limit(a, b)
        i, j = g.cell(a, b)
        m, q = np.flatnonzero(member), np.flatnonzero(~member)
        counts, edges = np.zeros(len(row), np.int64), []
        cell = i * len(g.right) + j
        order = m[np.argsort(cell[m], kind="stable")]
        held, first = np.unique(cell[order], return_index=True)
        slot = np.full(len(g.left) * len(g.right), len(held))
        slot[held] = np.arange(len(held))
        lefts, rights = np.unique(held // len(g.right)), np.unique(held % len(g.right))
        visited = np.zeros((len(q), len(held) + 1), bool)
        for who, ci, cj in multi_sequence(a[np.ix_(q, lefts)], b[np.ix_(q, rights)], limit[q]) if len(q) and len(m) else ():
            visited[who, slot[lefts[ci] * len(g.right) + rights[cj]]] = True
        for c, of in enumerate(np.split(order, first[1:])):
            visits = q[visited[:, c]]
            for s in range(0, len(visits), 2048):
                v = visits[s : s + 2048]
                close = x[v] @ x[of].T >= least - 1e-9
                close &= row[v][:, None] != row[of]
                p, r = np.nonzero(close)
                if not len(p):
                    continue
                p, r = v[p], of[r]
                for t in range(0, len(p), 200_000):
                    u, w = p[t : t + 200_000], r[t : t + 200_000]
                    dot = (raw[u] * raw[w]).sum(axis=1) / np.sqrt((raw[u] * raw[u]).sum(axis=1) * (raw[w] * raw[w]).sum(axis=1))
                    u, w = u[dot >= least], w[dot >= least]
                    np.add.at(counts, u, copies[w])
                    # The member counts the visitor here if it doesn't visit the visitor's cell itself.
                    alone = a[w, i[u]] + b[w, j[u]] > limit[w]
                    np.add.at(counts, w[alone], copies[u[alone]])
                    edges.append(_forest(row[u], row[w]))
        found = np.flatnonzero(counts)
        e = _forest(*np.concatenate(edges, axis=1)) if edges else np.zeros((2, 0), np.int64)
        none = np.full(len(found), -1)
        return pa.table({"row": np.concatenate([row[found], e[0]]), "n": np.concatenate([counts[found], np.zeros(e.shape[1], np.int64)]), "other": np.concatenate([none, e[1]])})

    out = keep(keyed.groupBy("zone", "block", "turn").applyInArrow(verify, "row long, n long, other long"), "found")
    n = out.where("other < 0").groupBy("row").agg(F.sum("n").alias("n_links"))
    return n, out.where("other >= 0").select(F.col("row").alias("a"), F.col("other").alias("b"))


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Links (2, m) of a star for each component of the given links, found by repeated least labels."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = label.copy()
        np.minimum.at(least, u, label[v])
        np.minimum.at(least, v, label[u])
        least = least[least]
        if (least == label).all():
            break
        label = least
    rest = np.flatnonzero(label != np.arange(len(nodes)))
    return np.stack([nodes[label[rest]], nodes[rest]])


def near_duplicates(table: DataFrame, least: float = LEAST) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    rows = keep(vectors.valid(table), "vectors")
    base = table.select(F.monotonically_increasing_id().alias("row"), "vec_id")
    classes = keep(rows.groupBy("v").agg(F.min("row").alias("row"), F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies")), "classes")
    n, total = classes.agg(F.count(F.lit(1)), F.sum("copies")).first()
    if n:
        counts, edges = links(classes, fit(vectors.sample(classes), n, least), least)
        linked = classes.join(counts, "row", "left").join(components(edges).withColumnRenamed("node", "row"), "row", "left").withColumn("component", F.coalesce("component", "row"))
        least_id = linked.groupBy("component").agg(F.min("vec_id").alias("component_id"))
        done = linked.join(least_id, "component").select("v", "copies", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
        done = keep(done.where("n_links > 0"), "classes")
        hot, rest = F.broadcast(done.where(F.col("copies") * HOT >= total)), done.where(F.col("copies") * HOT < total)
        found = ["row", "n_links", "component_id"]
        of = rows.join(hot, "v").select(*found).unionByName(rows.join(hot, "v", "left_anti").join(rest, "v").select(*found))
    else:
        of = table.sparkSession.createDataFrame([], "row long, n_links long, component_id long")
    return base.join(of, "row", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce(F.col("n_links").isNull() | (F.col("vec_id") == F.col("component_id")), F.lit(True)).alias("kept"),
    )


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op8_multi_index": op8}
ORACLES = {
    "op8_multi_index": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
c AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT c.x, l.y FROM c JOIN l ON c.y = l.x),
m AS (SELECT x, min(y) AS component_id FROM c GROUP BY x)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.x = v.vec_id) AS n_links, m.component_id, v.vec_id = m.component_id AS kept
FROM v JOIN m ON m.x = v.vec_id
"""
}
