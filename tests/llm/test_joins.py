import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from sedge.llm import components, multi_index, ngram_join, postings, vectors


def brute_shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({i: " " for i in (9, 10, 11, 12, 13)}).split(" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_copies(rng, groups=12, copies=12, words=60):
    out = []
    for g in range(groups):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(3, words))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**6)}"
            out.append(" ".join(w))
    return out


def test_components_equal_brute_force(spark):
    rng = random.Random(0)
    chain = [(i, i + 1) for i in range(60)]
    edges = chain + [(100, 100 + i) for i in range(1, 30)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    for x, c in got.items():
        assert find(x) == c


def test_shingle_sets_have_the_right_sizes_and_overlaps():
    texts = ["a b c d e f", "A B C\td E\n f", "a b", "", None, "  ", "é É ü a b c", "a b c d e a b c d e a", "x " * 3000]
    sets = [set(h.tolist()) for h in ngram_join.shingles(texts)]
    for (x, s), (y, t) in itertools.combinations(zip(texts, sets), 2):
        assert len(s & t) == len(brute_shingles(x) & brute_shingles(y))
    assert [len(s) for s in sets] == [len(brute_shingles(t)) for t in texts]


def test_tree_loses_no_pair():
    rng = np.random.default_rng(0)
    base = [rng.integers(0, 2**63, rng.integers(5, 900)).astype(np.uint64) for _ in range(30)]
    sets = [np.unique(np.concatenate([b[: int(len(b) * rng.uniform(0.8, 1))], rng.integers(0, 2**63, rng.integers(0, 5)).astype(np.uint64)])) for b in base for _ in range(6)]
    n = np.array([len(s) for s in sets])
    tree = ngram_join.Tree(n, [ngram_join.point(ngram_join.counts(s)) for s in sets])
    found = {tuple(sorted((int(tree.order[x]), int(tree.order[y])))) for i, j, _ in ngram_join.joined(tree, tree, lambda i, j: i >= 0) for x, y in zip(i, j)}
    want = {(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if 100 * len(k := np.intersect1d(sets[a], sets[b])) >= 75 * (n[a] + n[b] - len(k))}
    assert want <= found and len(found) < len(sets) * (len(sets) - 1) / 4


def test_join_equals_brute_force(spark):
    rng = random.Random(5)
    texts = near_copies(rng) + [None, "", " \n ", "one two", "one two", "ONE two"]
    ids = list(range(0, 7 * len(texts), 7))
    rng.shuffle(ids)
    df = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts)], "doc_id long, text string, component_id string")
    got = {r.doc_id: r for r in ngram_join.linked(df).collect()}
    sets = [brute_shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        k = len(sets[a] & sets[b])
        if k and 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
            root[find(a)] = find(b)
    for x, i in enumerate(ids):
        assert got[i].n_shingles == len(sets[x])
        assert got[i].component_id == min(ids[y] for y in range(len(ids)) if find(y) == find(x))
    kept = ngram_join.deduplicated(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {r.component_id for r in got.values()}


def test_blocks_of_hot_keys_are_joined_too(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    test_join_equals_brute_force(spark)


def test_empty_tables(spark):
    assert ngram_join.linked(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert multi_index.near_duplicates(none).count() == 0
    assert postings.search(none, F.col("vec_id") >= 0).count() == 0


def embeddings(spark, rng, n=900, d=16):
    x = rng.normal(size=(n, d))
    x[n // 3 : 2 * n // 3] = x[5] + 0.05 * rng.normal(size=(n - n // 3 - (n - 2 * n // 3), d))
    x[-20:] = x[:20]
    rows = [(int(i), v.tolist(), 0) for i, v in enumerate(x.astype(np.float32).astype(float))]
    odd = [(n, None, 0), (n + 1, [0.0] * d, 0), (n + 2, [float("nan")] + [1.0] * (d - 1), 0), (n + 3, [None] + [1.0] * (d - 1), 0), (n + 4, [1.0], 0), (n + 5, [float("inf")] * d, 0)]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, row int"), x.astype(np.float32).astype(np.float64)


def test_multi_index_equals_brute_force(spark):
    df, x = embeddings(spark, np.random.default_rng(1))
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = y @ y.T >= 0.9
    got = {r.vec_id: r for r in multi_index.near_duplicates(df).collect()}
    assert len(got) == len(x) + 6
    want = near.sum(axis=1) - 1
    n = np.array([got[i].n_links for i in range(len(x))])
    assert (n <= want).all() and n.sum() >= 0.98 * want.sum()
    assert all(got[i].component_id == i and got[i].kept and got[i].n_links == 0 for i in range(len(x), len(x) + 6))
    assert got[len(x) - 20].component_id == 0 and got[len(x) // 3 + 1].component_id == got[5].component_id


def test_multi_sequence_rises_and_is_whole():
    rng = np.random.default_rng(0)
    a, b, limit = rng.random((40, 7)), rng.random((40, 9)), rng.random(40) * 2
    got = [[] for _ in a]
    for who, i, j in multi_index.multi_sequence(a, b, limit):
        for v, p, q in zip(who, i, j):
            got[v].append((int(p), int(q)))
    for v, cells in enumerate(got):
        sums = [a[v, i] + b[v, j] for i, j in cells]
        assert sums == sorted(sums) and len(set(cells)) == len(cells)
        assert set(cells) == {(i, j) for i in range(7) for j in range(9) if a[v, i] + b[v, j] <= limit[v]}


def test_zones_of_both_halves_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "ZONE_ROWS", 50)
    monkeypatch.setattr(multi_index, "TASK_ROWS", 100)
    monkeypatch.setattr(multi_index, "MOST_ZONES", 3)
    test_multi_index_equals_brute_force(spark)


def test_equal_vectors_count_as_rows(spark):
    """A third of all rows is one vector, under a null id too; its links count each copy."""
    near, far = [1.0, 0.0, 0.0, 0.3], [0.0, 1.0, 0.0, 0.0]
    rows = [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(10, 40)] + [(None, [1.0, 0.0, 0.0, 0.0]), (5, near), (6, near), (7, far), (7, far), (8, [0.0, 0.0, 1.0, 0.0]), (9, None)]
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in multi_index.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(0, 32, 5, True), (5, 32, 5, True), (6, 32, 5, False), (7, 1, 7, True), (7, 1, 7, True), (8, 0, 8, True), (9, 0, 9, True)] + [(i, 32, 5, False) for i in range(10, 40)]


def test_postings_recall_and_exact_scores(spark):
    df, x = embeddings(spark, np.random.default_rng(2), n=1500)
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = postings.search(df, F.col("vec_id") % 10 == 0).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append(r)
    hits = 0
    for q in range(0, len(x), 10):
        s = np.delete(y @ y[q], q)
        ids = np.delete(np.arange(len(x)), q)
        want = ids[np.lexsort((ids, -np.round(s, 12)))[:5]]
        assert [r["rank"] for r in by[q]] == [1, 2, 3, 4, 5]
        assert all(abs(r.score - y[r.vec_id] @ y[q]) < 1e-12 and r.vec_id != q for r in by[q])
        hits += len({r.vec_id for r in by[q]} & set(want.tolist()))
    assert hits >= 0.9 * 5 * len(range(0, len(x), 10))
    assert set(by) == set(range(0, len(x), 10))


def test_lists_are_near_even():
    x = np.random.default_rng(0).normal(size=(4000, 8))
    x[:1500] = x[0] + 0.01 * x[:1500]
    lists = postings.fit(x, 4000)
    _, home = lists.homes(vectors.unit(x), lists.between())
    assert np.bincount(home).max() < 12 * len(home) / len(lists.centroids)
