from collections import Counter

import numpy as np

from sedge.llm import toxicity

SF = "/root/testdata/sf0.01"


def test_nearest_equals_brute_force():
    rng = np.random.default_rng(0)
    v = np.where(rng.random((500, 60)) < 0.1, rng.random((500, 60)), 0)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    v[250:300] = v[200]
    index = toxicity.Index({}, np.ones(60), np.arange(500), np.arange(500) % 2, v, np.ones(500), 0.5)
    who, best = index.nearest(v[::7], 5)
    s = np.round(v[::7] @ v.T, 12)
    for i, row in enumerate(s):
        want = np.lexsort((np.arange(500), -row))[:5]
        assert np.allclose(best[i], row[want], atol=1e-11)
        assert [w for w, c in zip(who[i], best[i]) if c > 0] == [w for w in want if row[w] > 0]


def test_held_out_separation(spark):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = toxicity.op4(spark, SF).collect()
    assert len({r.doc_id for r in rows}) == len(rows) == 1000
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    pos, neg = [s for s, t in held if t], [s for s, t in held if not t]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert auc > 0.8


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, "bad awful", 0.0), (2, None, 0.0), (3, "", 0.0), (3, "", 0.0)], "doc_id long, text string, score double")
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.score for r in toxicity.score(docs, none, ["doc_id"]).collect()] == [0.0] * 4
    rows = [(i, f"nice day number {chr(97 + i)}" if i % 2 else f"awful bad {chr(97 + i)}") for i in range(20)]
    some = spark.createDataFrame(rows, "doc_id long, text string")
    index = toxicity.fit(some, spark.createDataFrame([(i, 1 - i % 2) for i in range(20)] + [(0, 1)], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(docs, index, ["doc_id"]).collect()}
    assert got[1].predicted == 1 and got[1].evidence[0].toxic == 1
    assert got[2].score == got[3].score


def test_query_equals_brute_force(spark):
    """Every score and piece of evidence from all cosines of plain dictionaries."""
    import math

    sf = "/root/testdata/sf0.001"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    index = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic").where(~toxicity._held_out()))
    got = {r.doc_id: r for r in toxicity.op4(spark, sf).collect()}
    count = toxicity.TermCounter(index.vocabulary)
    df = Counter(t for _, x in texts for t in count(x))

    def vector(text):
        v = {t: (1 + math.log(n)) * (math.log((len(texts) + 1) / (df[t] + 1)) + 1) for t, n in count(text).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    by_id, place = dict(texts), {int(d): i for i, d in enumerate(index.ids)}
    examples = {d: vector(by_id[d]) for d in place}
    assert len(examples) > toxicity.NEIGHBOURS
    for doc_id, text in texts:
        q = vector(text)
        scores = sorted(((-round(sum(x * v.get(t, 0) for t, x in q.items()), 12), place[d], d) for d, v in examples.items()))
        near = [(d, -c) for c, _, d in scores[: toxicity.NEIGHBOURS] if c < 0]
        votes = [(c * c * index.votes[place[d]], index.labels[place[d]]) for d, c in near]
        raw = (toxicity.PRIOR_VOTES * index.prior + sum(w * y for w, y in votes)) / (toxicity.PRIOR_VOTES + sum(w for w, _ in votes))
        want = float(index.calibrated(np.array([raw]))[0])
        assert abs(got[doc_id].score - want) < 1e-9
        assert [round(e.cosine, 9) for e in got[doc_id].evidence] == [round(c, 9) for _, c in near[: toxicity.EVIDENCE]]
