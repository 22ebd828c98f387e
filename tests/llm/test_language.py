import itertools

import numpy as np

from sedge.llm import language

SF = "/root/testdata/sf0.001"


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(0)
    for n in (1, 5, 7):
        s = rng.normal(size=(n, 3)) * 3
        best = max(itertools.product(range(3), repeat=n), key=lambda p: sum(s[i, x] for i, x in enumerate(p)) - 2 * sum(a != b for a, b in zip(p, p[1:])))
        assert tuple(language.viterbi(s, np.array([0, n]), 2.0)) == best


def test_viterbi_over_segments_equals_one_pass():
    rng = np.random.default_rng(1)
    sizes = [0, 1, 64, 65, 300, 0, 1000]
    first = np.concatenate([[0], np.cumsum(sizes)])
    s = rng.normal(size=(first[-1], 4)) * 3
    got = language.viterbi(s, first, 2.5)
    for a, b in zip(first[:-1], first[1:]):
        path = got[a:b]
        v = np.zeros(4)
        for row in s[a:b]:
            v = np.maximum(v, v.max() - 2.5) + row
        mine = sum(s[a + i, x] for i, x in enumerate(path)) - 2.5 * np.sum(path[1:] != path[:-1])
        assert abs(mine - v.max()) < 1e-9


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = language.op3(spark, SF).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95


def test_defined_cases_and_mixed_spans(spark):
    rows = [(i, t, lang, "x") for i, (t, lang) in enumerate([("the cat sat on the mat with that hat", "en"), ("кошка сидит на окне и смотрит", "ru"), ("the other thing is that", "en"), ("мама мыла раму", "ru"), (None, "en"), ("1234 !!", None), ("", "en")] * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = language.fit(docs)
    assert model.languages == ["en", "ru"]
    got = language.label(model, ["the cat sat on the mat кошка сидит на окне и смотрит", None, "12", "λόγος"], spans=True)
    assert got[0][2] == [(0, 6, "en"), (6, 6, "ru")]
    assert got[1] == ("und", 0.0, []) == got[2]
    assert got[3][0] in ("en", "ru")  # a script that none uses: all remain
    kept = language.kept(docs)
    assert kept.columns == docs.columns and {r.text for r in kept.collect()} <= {t for _, t, _, _ in rows if t}
    empty = language.fit(docs.where("false"))
    assert language.label(empty, ["abc"]) == [("und", 0.0)]
