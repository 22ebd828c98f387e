import importlib
import itertools
from collections import Counter

import pytest

from test_joins import brute_shingles
from test_secrets import brute

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages_one_by_one_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, tables = docs.columns, [docs.collect()]
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns, name
        tables.append(docs.collect())
    raw, known, apart, masked, mixed, tokens = tables
    assert {r.doc_id for r in raw} - {r.doc_id for r in known} <= {r.doc_id for r in raw if not any(c.isalpha() for c in r.text or "")}
    sets = {r.doc_id: brute_shingles(r.text) for r in known}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    assert {r.doc_id for r in apart} == {find(i) for i in sets}
    before = {r.doc_id: r.text for r in apart}
    for r in masked:
        assert (brute(before[r.doc_id]) == "" or r.text != before[r.doc_id]) and brute(r.text) == ""
        assert r.n_chars == len(r.text)
    words = lambda rows: {r.doc_id: len(brute_words(r.text)) for r in rows}
    size, taken = words(masked), Counter()
    for r in mixed:
        taken[r.doc_id] += len(brute_words(r.text))
    assert all(taken[i] <= 2 * size[i] for i in taken)
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) < 0.05 * sum(size.values())
    lib = importlib.import_module("tokenizers").Tokenizer.from_file(pipeline.bpe.tokenizer_path())
    want = Counter((r.doc_id, " ".join(map(str, lib.encode(r.text, add_special_tokens=False).ids))) for r in mixed)
    assert Counter((r.doc_id, r.ids) for r in tokens) == want


def brute_words(text):
    return [w for w in (text or "").translate({i: " " for i in (9, 10, 11, 12, 13)}).split(" ") if w]


def test_run_gives_tokens(spark):
    out = pipeline.run(spark, SF)
    assert out.where("n_tokens > 0").count() > 100
