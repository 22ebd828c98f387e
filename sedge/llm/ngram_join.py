"""Jaccard join of word-shingle sets by an R-tree over their group counts.

A set's shingles are hashed into groups; its counts by group are a point. Two sets share
at most the sum of their coordinate minima, so that a pair of points, or of the tree's
boxes, whose sum is too small for the threshold is out. What is left is verified on the
whole sets.

The least shingle hashes find the pairs and the trees rule most of them out: a tree is built
under each of a set's least hashes. Two linked sets have one of these in common for certain
when a set's hashes are all of its prefix (sets up to 4 * (KEYS - 1) shingles), and but for a
chance of 4 ** -KEYS beyond. Equal sets are one node. Nodes first meet the least node of each
key. What that leaves apart meets in the trees, each pair under the least key that it shares:
first with counts alone, which leaves the nodes of pairs that could be links; then with these
nodes' whole sets, where the pairs are verified, likeliest first, unless links found so far
connect them already. A tree hands on a forest of verified links, so that no group of copies is
ever written out as pairs and no link between components is lost.

Nodes under a frequent key are dealt into cells by their sizes and, of one size, by hash; two
cells meet only if sets of their sizes could be linked.

Defined cases: null and empty texts, and texts of white space, have no shingles and are
linked with nothing, not even each other; repeated rows are equal sets; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_kept, keep, shielded, table, trimmed
from .components import components

WORDS = 5
#: Least similarity, in hundredths.
LEAST = 75
KEYS = 24
#: Groups of the tree's points; larger sets have a power of two times as many, folded to these for the tree.
GROUPS = 64
MOST_GROUPS = 1 << 16
#: A count that a byte can't hold; it bounds nothing.
MANY = 255
#: Pairs of two longs that are broadcast to a scan, at most (16 MB); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
LEAF = 16
#: Nodes under one key that one tree holds, and shingles in their sets; more are dealt into cells.
BLOCK = 2048
BLOCK_SHINGLES = 1 << 21
#: Sets whose sizes differ by more than this factor can't be linked (a little over 100 / LEAST).
BAND = 1.34
#: Pairs that are held before they are verified, and verified before links are looked at again.
HELD_PAIRS = 1 << 14
STEP = 256
CHUNK = 1 << 20
U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finalizer."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    return tuple(np.cumprod(np.concatenate([[U(1)], np.full(n, U(b), dtype=np.uint64)])) for b in (base, inverse))


_kept_powers = functools.lru_cache(maxsize=1)(_power_table)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers up to n; one table serves all chunks of common size, and a very long text's is not kept."""
    return _kept_powers(2 * CHUNK) if n <= 2 * CHUNK else _power_table(n)


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _BYTE[_LOWER]
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def shingles(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles: all words of a chunk of texts are hashed at once."""
    out: list[np.ndarray] = []
    at, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= CHUNK or i + 1 == len(texts):
            out += _shingles([(x or "").encode() for x in texts[at : i + 1]])
            at, held = i + 1, 0
    return out


def _shingles(texts: list[bytes]) -> list[np.ndarray]:
    data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", dtype=np.uint8)
    size = 1 << (len(data) - 1).bit_length()
    power, inverse = _powers(size)
    space = _SPACE[data]
    with np.errstate(over="ignore"):
        total = np.concatenate([[U(0)], np.cumsum(_BYTE[data] * power[: len(data)], dtype=np.uint64)])
        edge = np.diff(space.astype(np.int8))
        start, end = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
        words = _mix((total[end] - total[start]) * inverse[start])
        bounds = np.cumsum([1, *[len(t) + 1 for t in texts]])
        first = np.searchsorted(start, bounds)
        rolled = np.zeros(max(len(words) - WORDS + 1, 0), dtype=np.uint64)
        for k in range(WORDS):
            rolled = rolled * U(0xD6E8FEB86659FD93) + words[k : k + len(rolled)]
        rolled = _mix(rolled + U(WORDS))
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= WORDS:
                h = np.sort(rolled[a : b - WORDS + 1])
                out.append(h[np.concatenate([[True], h[1:] != h[:-1]])])
            elif b > a:
                h = U(0)
                for w in words[a:b]:
                    h = h * U(0xD6E8FEB86659FD93) + w
                out.append(_mix(np.array([h + U(b - a)], dtype=np.uint64)))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
    return out


def counts(h: np.ndarray) -> bytes:
    """Counts by group of a set, a byte each; the number of groups is a power of two from half the set's size."""
    groups = min(MOST_GROUPS, max(GROUPS, 1 << max(0, len(h) // 2 - 1).bit_length()))
    return np.minimum(np.bincount((h & U(groups - 1)).astype(np.int64), minlength=groups), MANY).astype(np.uint8).tobytes()


def point(data) -> np.ndarray:
    v = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
    v[v == MANY] = 1 << 24
    return v


def folded(vector: np.ndarray, groups: int) -> np.ndarray:
    return vector.reshape(-1, groups).sum(axis=0)


def needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least intersection of sets of sizes a and b that links them."""
    return -(-LEAST * (a + b) // (100 + LEAST))


class Tree:
    """A packed R-tree over count vectors: leaves of points alike in size and strongest coordinate, boxes by their maxima."""

    def __init__(self, sizes: np.ndarray, vectors: list[np.ndarray]):
        base = np.stack([folded(v, GROUPS) for v in vectors])
        order = np.argsort(sizes, kind="stable")
        strip = max(LEAF, int(np.ceil(np.sqrt(len(order) / LEAF))) * LEAF)
        wide = base.var(axis=0).argmax()
        order = np.concatenate([s[np.argsort(base[s, wide], kind="stable")] for s in (order[i : i + strip] for i in range(0, len(order), strip))])
        self.order, self.sizes, self.base, self.vectors = order, sizes[order], base[order], [vectors[i] for i in order]
        self.groups, self.folds = np.array([len(v) for v in self.vectors]), {}
        #: By level from the points up: least and greatest size and the coordinates' maxima of each box.
        self.levels = [(self.sizes, self.sizes, self.base)]
        while len(self.levels[-1][0]) > 1:
            low, high, most = self.levels[-1]
            cut = range(0, len(low), LEAF)
            self.levels.append((np.array([low[i : i + LEAF].min() for i in cut]), np.array([high[i : i + LEAF].max() for i in cut]), np.stack([most[i : i + LEAF].max(axis=0) for i in cut])))

    def level(self, k: int):
        return self.levels[min(k, len(self.levels) - 1)]

    def at(self, groups: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows by point and counts, folded to so many groups, of the points that have as many."""
        if groups not in self.folds:
            has = np.flatnonzero(self.groups >= groups)
            row = np.full(len(self.groups), -1)
            row[has] = np.arange(len(has))
            self.folds[groups] = (row, np.stack([folded(self.vectors[x], groups) for x in has]))
        return self.folds[groups]


def joined(left: Tree, right: Tree, apart) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of points (positions in each tree) that their counts don't rule out, with the most they could share beyond need.

    ``apart(i, j)`` tells which pairs of points matter. Boxes are compared level by level from the roots.
    """
    same = left is right
    top = max(len(left.levels), len(right.levels)) - 1

    def descend(i, j, level):
        a, b = left.level(level), right.level(level)
        fits = (a[1][i] * 100 >= LEAST * b[0][j]) & (b[1][j] * 100 >= LEAST * a[0][i])
        i, j = i[fits], j[fits]
        if level == 0:
            # Points: only the pairs that matter.
            fits = apart(i, j) & ((i < j) if same else np.ones(len(i), bool))
            i, j = i[fits], j[fits]
        most = np.minimum(a[2][i], b[2][j]).sum(axis=1)
        slack = most - needed(a[0][i], b[0][j])
        fits = slack >= 0
        i, j, slack = i[fits], j[fits], slack[fits]
        if not len(i):
            return
        if level == 0:
            # As many groups as both points have; all pairs of one number of groups at once.
            common = np.minimum(left.groups[i], right.groups[j])
            for g in np.unique(common[common > GROUPS]).tolist():
                of = np.flatnonzero(common == g)
                (p, v), (q, w) = left.at(g), right.at(g)
                step = max(1, (1 << 21) // g)
                for c in range(0, len(of), step):
                    own = of[c : c + step]
                    slack[own] = np.minimum(v[p[i[own]]], w[q[j[own]]]).sum(axis=1) - needed(left.sizes[i[own]], right.sizes[j[own]])
            fine = slack >= 0
            yield i[fine], j[fine], slack[fine]
            return
        for s in range(0, len(i), 256):
            p, q = i[s : s + 256], j[s : s + 256]
            ci, cj = (np.arange(LEAF) + x[:, None] * LEAF if len(t.levels) > level else np.concatenate([x[:, None], np.full((len(x), LEAF - 1), 1 << 40)], axis=1) for x, t in ((p, left), (q, right)))
            ni, nj = len(left.level(level - 1)[0]), len(right.level(level - 1)[0])
            gi, gj = np.broadcast_to(ci[:, :, None], (len(p), LEAF, LEAF)).ravel(), np.broadcast_to(cj[:, None, :], (len(p), LEAF, LEAF)).ravel()
            real = (gi < ni) & (gj < nj)
            if same:
                real &= gi <= gj
            yield from descend(gi[real], gj[real], level - 1)

    zero = np.zeros(1, dtype=np.int64)
    yield from descend(zero, zero, top)


def signatures(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, n, node (a hash of the set; null if empty), keys and counts."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                sets = shingles(part.column("text").to_pylist())
                with np.errstate(over="ignore"):
                    node = [int(_mix(h ^ U(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)) if len(h) else None for h in sets]
                keys = [h[: min(KEYS, len(h) - (-(-LEAST * len(h) // 100)) + 1)].astype(np.int64) if len(h) else [] for h in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), pa.array([len(h) for h in sets], pa.int64()), pa.array(node, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array([counts(h) for h in sets], pa.binary())],
                    ["row", "doc_id", "n", "node", "keys", "counts"],
                )

    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(trimmed(run), "row long, doc_id long, n long, node long, keys array<long>, counts binary")


def _sets(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, set) of the nodes in ``pairs``, made anew from their texts."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "row"), "node")
    wanted = keep(wanted, "wanted")
    small = wanted.count() <= BROADCAST_ROWS

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([h.tobytes() for h in shingles(part.column("text").to_pylist())], pa.binary())], ["node", "set"])

    texts = docs.select(F.monotonically_increasing_id().alias("row"), "text")
    return texts.join(F.broadcast(wanted) if small else wanted, "row").select("node", "text").mapInArrow(trimmed(run), "node long, set binary")


def _bounded(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose counts could hold a link."""
    of = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("counts").alias(f"c_{c}"))

    def run(batches):
        for batch in batches:
            na, nb = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            most = np.zeros(batch.num_rows, dtype=np.int64)
            for i, (x, y) in enumerate(zip(batch.column("c_a"), batch.column("c_b"), strict=True)):
                v, w = point(x.as_buffer()), point(y.as_buffer())
                g = min(len(v), len(w))
                most[i] = np.minimum(folded(v, g), folded(w, g)).sum()
            yield batch.select(["a", "b"]).filter(pa.array(most >= needed(na, nb)))

    likely = F.expr(f"n_a * 100 >= n_b * {LEAST} and n_b * 100 >= n_a * {LEAST}")
    return pairs.join(of("a"), "a").join(of("b"), "b").where(likely).mapInArrow(trimmed(run), "a long, b long")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sets are similar enough."""
    pairs = keep(pairs, "pairs")
    sets = keep(_sets(docs, nodes, pairs), "sets")

    def run(batches):
        for batch in batches:
            ok = [_similar(np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)) for x, y in zip(batch.column("s_a"), batch.column("s_b"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    of = lambda c: sets.select(F.col("node").alias(c), F.col("set").alias(f"s_{c}"))
    out = keep(pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(trimmed(run), "a long, b long"), "verified")
    drop_kept(sets)
    return out


def _similar(v: np.ndarray, w: np.ndarray) -> bool:
    both = np.sort(np.concatenate([v, w]))
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= LEAST * (len(v) + len(w) - shared)


class Forest:
    """Labels of nodes, merged by the links that a tree's pairs turn out to be."""

    def __init__(self, parts: np.ndarray, sets: list[np.ndarray]):
        self.label, self.sets = np.unique(parts, return_inverse=True)[1], sets
        self.links: list[tuple[int, int]] = []
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, a: np.ndarray, b: np.ndarray, slack: np.ndarray) -> None:
        self.held.append((a, b, slack))
        self.size += len(a)
        if self.size >= HELD_PAIRS:
            self.settle()

    def settle(self) -> None:
        """Verify what is held, likeliest first and in growing steps, but for pairs that links connect by then."""
        if not self.held:
            return
        a, b, slack = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.size = [], 0
        order = np.argsort(-slack, kind="stable")
        a, b, step = a[order], b[order], STEP
        while True:
            open_ = self.label[a] != self.label[b]
            a, b = a[open_], b[open_]
            if not len(a):
                return
            for x, y in zip(a[:step].tolist(), b[:step].tolist(), strict=True):
                if self.label[x] != self.label[y] and _similar(self.sets[x], self.sets[y]):
                    self.links.append((x, y))
                    self.label[self.label == self.label[y]] = self.label[x]
            a, b, step = a[step:], b[step:], 2 * step


def _least_shared(keys: np.ndarray, key: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs share no key below ``key``; ``keys`` has a row of keys for each node, padded by itself."""
    out = np.ones(len(a), bool)
    below = np.sort(np.where(keys < key, keys, np.iinfo(np.int64).max), axis=1)
    width = int((below < key).sum(axis=1).max(initial=0))
    below = below[:, :width]
    for s in range(0, len(a), 4096):
        v, w = below[a[s : s + 4096]], below[b[s : s + 4096]]
        out[s : s + 4096] = ~((v[:, :, None] == w[:, None, :]) & (v < key)[:, :, None]).any(axis=(1, 2))
    return out


def _in_groups(work, out: list[str]):
    """A function over Arrow batches whose rows stand together by (key, i, j): ``work`` makes columns of each such group."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush(t: pa.Table):
            if t.num_rows > 1 and (got := work(t)) is not None:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], out)

        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(a, b - a)
                if held and any(held[-1].column(c)[0].as_py() != part.column(c)[0].as_py() for c in ("key", "i", "j")):
                    yield from flush(pa.Table.from_batches(held))
                    held = []
                if part.num_rows:
                    held.append(part)
        if held:
            yield from flush(pa.Table.from_batches(held))

    return run


def _trees(group: pa.Table) -> tuple[list[Tree], list[np.ndarray]] | None:
    """The tree of a cell by itself, or those of two cells that meet, with each point's row of the group."""
    own, n = group.column("own").to_numpy(), group.column("n").to_numpy()
    i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
    halves = [np.flatnonzero(own == x) for x in ([i] if i == j else [i, j])]
    if not all(len(h) for h in halves):
        return None
    vectors = [point(x.as_buffer()) for c in group.column("counts").chunks for x in c]
    trees = [Tree(n[h], [vectors[x] for x in h]) for h in halves]
    return trees, [h[t.order] for h, t in zip(halves, trees, strict=True)]


def _dealt(shared: DataFrame, nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """(key, i, j, own, node, component): the cells of nodes under the keys that hold more than one component."""
    rows = shared.select("key", "node", "n").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    of_key = rows.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("m"), F.sum("n").alias("s")).where("x <> y")
    rows = rows.join(of_key.select("key", ((F.col("m") > BLOCK) | (F.col("s") > BLOCK_SHINGLES)).alias("frequent")), "key")
    rows = rows.withColumn("band", F.when(F.col("frequent"), F.floor(F.log(BAND, F.col("n")))).otherwise(0).cast("long"))
    shape = rows.groupBy("key", "band").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("long").alias("blocks"))
    shape = keep(shape, "shape")
    near = shape.select("key", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), F.col("band").alias("other_band"), F.col("blocks").alias("other_blocks"))
    near = near.join(shape, ["key", "band"])
    cell = lambda band, block: F.shiftleft(band, 32) + block
    rows = rows.join(near, ["key", "band"]).withColumn("own", cell(F.col("band"), F.pmod(F.xxhash64("node", "key"), F.col("blocks"))))
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("other_blocks") - 1))).withColumn("other", cell(F.col("other_band"), F.col("block")))
    return rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "component")


def _together(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _tree_links(shared: DataFrame, nodes: DataFrame, parts: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) between components, as a forest of verified ones from each tree."""
    columns = ["key", "i", "j", "own", "node", "component"]

    def likely(group: pa.Table):
        """The nodes of pairs that counts don't rule out and that share no lesser key."""
        if (got := _trees(group)) is None:
            return None
        (trees, place), key = got, group.column("key")[0].as_py()
        part = group.column("component").to_numpy()
        lists = group.column("keys").combine_chunks()
        flat, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
        keys = np.full((len(part), KEYS), np.iinfo(np.int64).max)
        width = np.diff(ends, prepend=0)
        keys[np.repeat(np.arange(len(part)), width), np.arange(len(flat)) - np.repeat(ends - width, width)] = flat
        left, right = place[0], place[-1]
        wanted = np.zeros(len(part), bool)
        for a, b, _ in joined(trees[0], trees[-1], lambda x, y: part[left[x]] != part[right[y]]):
            a, b = left[a], right[b]
            own = _least_shared(keys, key, a, b)
            wanted[a[own]] = wanted[b[own]] = True
        if not wanted.any():
            return None
        return [group.column(c).to_numpy()[wanted] for c in columns]

    def verified(group: pa.Table):
        """A forest of the links of a group; pairs that counts rule out can't be links."""
        if (got := _trees(group)) is None:
            return None
        trees, place = got
        node = group.column("node").to_numpy()
        forest = Forest(group.column("component").to_numpy(), [np.frombuffer(x.as_buffer(), dtype=np.uint64) for c in group.column("set").chunks for x in c])
        left, right = place[0], place[-1]
        for a, b, slack in joined(trees[0], trees[-1], lambda x, y: forest.label[left[x]] != forest.label[right[y]]):
            forest.add(left[a], right[b], slack)
        forest.settle()
        if not forest.links:
            return None
        a, b = np.array(forest.links).T
        return node[a], node[b]

    points = _dealt(shared, nodes, parts).join(nodes.select("node", "n", "counts", "keys"), "node")
    wanted = keep(_together(points.select(*columns, "n", "counts", "keys")).mapInArrow(trimmed(_in_groups(likely, columns)), "key long, i long, j long, own long, node long, component long"), "likely")
    sets = keep(_sets(docs, nodes, wanted.select(F.col("node").alias("a"), F.col("node").alias("b"))), "sets")
    whole = wanted.join(nodes.select("node", "n", "counts"), "node").join(sets, "node").select(*columns, "n", "counts", "set")
    out = keep(_together(whole).mapInArrow(trimmed(_in_groups(verified, ["a", "b"])), "a long, b long"), "links")
    drop_kept(sets)
    drop_kept(wanted)
    return out


def linked(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_shingles, component_id, part) of the rows of ``docs``, which has doc_id and text; part names a component whatever its ids, and is null without shingles."""
    found = keep(signatures(docs), "signatures")
    nodes = found.where("node is not null").groupBy("node").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("counts").alias("counts"))
    nodes = keep(nodes, "nodes")
    rows_of = keep(found.select("row", "doc_id", "n", "node"), "rows")
    drop_kept(found)
    by_key = nodes.select(F.explode("keys").alias("key"), "node", "n")
    keys = by_key.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("least")).where("m > 1").select("key", "least")
    shared = keep(by_key.join(keys, "key"), "shared")
    # Each node meets the least node of the key group with which it shares most keys.
    met = shared.where("node <> least").groupBy("node", "least").agg(F.count(F.lit(1)).alias("m"))
    stars = met.groupBy("node").agg(F.max(F.struct("m", (-F.col("least")).alias("least"))).alias("most")).select((-F.col("most.least")).alias("a"), F.col("node").alias("b"))
    parts = keep(components(_verified(_bounded(stars, nodes), nodes, docs)), "parts")
    more = _tree_links(shared, nodes, parts, docs)
    if not more.isEmpty():
        # Components so far, each a star, with the links that the trees have found.
        parts = keep(components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)), "parts")
    drop_kept(shared)
    rows = rows_of.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    least = rows.where("part is not null").groupBy("part").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "part", "left").select("row", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "part")


@shielded
def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each component, the first row of its least doc_id, null ids last; the columns of ``docs``."""
    rows = linked(docs)
    alone = rows.where("n_shingles = 0").select("row")
    first = rows.where("n_shingles > 0").groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least")).select("least.row")
    return docs.withColumn("_row", F.monotonically_increasing_id()).join(alone.unionByName(first).withColumnRenamed("row", "_row"), "_row", "left_semi").select(*docs.columns)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("row", "part")


QUERIES = {"op7_ngram_join": op7}
ORACLES = {
    "op7_ngram_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n na ON na.doc_id = x JOIN n nb ON nb.doc_id = y WHERE 100 * k >= 75 * (na.n + nb.n - k)),
c AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT c.x, l.y FROM c JOIN l ON c.y = l.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS component_id FROM c GROUP BY x) m ON m.x = d.doc_id
"""
}
