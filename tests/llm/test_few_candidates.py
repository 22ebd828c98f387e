import numpy as np
from pyspark.sql import functions as F

from sedge.llm import postings


def test_isolated_copies_get_as_many_rows_as_others(spark, monkeypatch):
    rng = np.random.default_rng(0)
    c = np.eye(8)[:4]
    v = np.concatenate([c[:1], c[1:2], c[1:2], *(c[g] + 0.05 * rng.standard_normal((200, 8)) for g in (2, 3))])
    monkeypatch.setattr(postings, "fit", lambda x, rows: postings.Lists(c, postings.navigable(c), 0.05))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    rows = postings.search(df, F.col("vec_id") < 3).collect()
    got = {q: [r.vec_id for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == q] for q in range(3)}
    assert all(len(set(x)) == 5 and q not in x for q, x in got.items())
    assert got[1][0] == 2 and got[2][0] == 1
    assert {len([r for r in postings.search(df.where("vec_id < 4"), F.col("vec_id") < 4).collect() if r.query_id == q]) for q in range(4)} == {3}
