from collections import defaultdict

from sedge.llm import mixing

SF = "/root/testdata/sf0.001"


def sizes(spark, rows):
    return spark.createDataFrame([(i, i, s, n) for i, (s, n) in enumerate(rows)], "row long, doc_id long, source string, size long")


def test_sources_come_near_their_targets(spark):
    by, target, size = defaultdict(int), {}, {}
    rows = mixing.mix(mixing.sized(spark.read.parquet(f"{SF}/documents.parquet"))).collect()
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        by[r.source_size, r.target] += r.taken
    for (source_size, goal), taken in by.items():
        assert goal <= 2 * source_size + 1e-6
        assert abs(taken - goal) <= max(2 * mixing.BLOCK_WORDS, 0.02 * goal)
    assert abs(sum(t for _, t in by) - 1.5 * sum(s for s, _ in by)) < 1e-3


def test_caps_reshare_and_null_source_is_last(spark):
    got = {r.source: r.target for r in mixing.source_targets(sizes(spark, [("a", 10), ("b", 1000), (None, 500), ("c", 0)])).collect()}
    assert got["a"] == 20 and got["c"] == 0
    # b weighs 1 and the null source (last) 3: 2245 left, the null source stops at 1000.
    assert got[None] == 1000 and got["b"] == 1.5 * 1510 - 1020


def test_quotas_equal_the_highest_quotients(spark):
    votes = [53000, 24000, 23000, 11, 0]
    df = spark.createDataFrame(list(enumerate(votes)), "i int, v long")
    for seats in (0, 1, 3, 10, 97):
        from pyspark.sql import functions as F

        got = {r.i: r.quota for r in mixing.apportion(df, "v", F.lit(seats), [], ["i"]).collect()}
        won = defaultdict(int)
        for _ in range(seats):
            won[max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))] += 1
        assert got == {i: won[i] for i in range(len(votes))}


def test_defined_cases(spark):
    assert mixing.mix(sizes(spark, [])).count() == 0
    rows = mixing.mix(sizes(spark, [("a", 0), ("a", 0), (None, 0)])).collect()
    assert [(r.size, r.taken, r.target) for r in rows] == [(0, 0, 0.0)] * 3


def test_mixed_documents_hold_the_taken_words(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sum(r.taken for r in mixing.mix(mixing.sized(docs)).collect())
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert sum(r.size for r in mixing.sized(out).collect()) == want
