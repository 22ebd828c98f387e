import numpy as np
from pyspark.sql import functions as F

from sedge.llm import postings


def nearest(rows):
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return got


def test_large_groups_of_equal_vectors_answer_in_order_of_ids(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(400, 8))
    v[100:300] = v[0]  # half of the rows are one vector
    v[300:303] = v[1]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = nearest(postings.search(df, F.col("vec_id") % 2 == 0).collect())
    assert set(got) == set(range(0, 400, 2))
    assert [x[1] for x in got[0]] == [100, 101, 102, 103, 104]
    assert [x[1] for x in got[102]] == [0, 100, 101, 103, 104]
    assert [x[1] for x in got[298]] == [0, 100, 101, 102, 103]
    assert {x[1] for x in got[300][:3]} == {1, 301, 302} and len(got[300]) == 5
    assert all([r for r, _, _ in x] == [1, 2, 3, 4, 5] for x in got.values())
    y = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits = 0
    for q, x in got.items():
        s = y @ y[q]
        s[q] = -2
        assert all(abs(score - s[i]) < 1e-12 for _, i, score in x)
        hits += sum(score >= np.sort(s)[-5] - 1e-12 for _, _, score in x)
    assert hits >= 0.9 * 5 * len(got)


def test_one_vector_in_all_rows_and_null_ids(spark):
    ids = [7, None, 3, 3, 50]
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in ids], "vec_id long, embedding array<double>")
    got = nearest(postings.search(df, F.col("vec_id") % 50 == 0).collect())
    assert list(got) == [50] and [x[1] for x in got[50]] == [3, 3, 7, None]
    assert all(abs(x[2] - 1) < 1e-12 for x in got[50])
