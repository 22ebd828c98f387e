"""Nulls in every column, empty and very long texts, ties, repeated rows and clashing names, through every stage and operator."""

import pytest
from pyspark.sql import functions as F

from sedge.llm import bpe, language, mixing, ngram_join, secrets, toxicity

LONG = " ".join(f"word{i % 5000}" for i in range(60_000))
ROWS = [
    (1, "the cat sat on the mat with the hat", "en", "a", 35), (1, "the cat sat on the mat with the hat", "en", "a", 35), (2, None, None, None, None), (None, "a text whose id is null here", "en", None, 1),
    (3, "", "en", "a", 0), (4, LONG, "en", "b", len(LONG)), (5, LONG + " password=abcdef0123456789", "en", "b", 1), (6, "le chat est sur la table avec le chien", "fr", "b", 3), (7, "12 34", "en", "c", 5),
]
EXTRA = ["_row", "_base", "_tokens", "_text", "score", "node", "row", "_id", "_size", "size", "keys"]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cases") / "docs")
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    df.select("*", *[F.lit(f"own {c}").alias(c) for c in EXTRA]).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("stage", [language.kept, ngram_join.deduplicated, secrets.redacted, mixing.mixed_documents])
def test_stages_keep_names_and_values(docs, stage):
    out = stage(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert all(r[c] == f"own {c}" for r in rows for c in EXTRA)
    assert stage(docs.where("false")).count() == 0
    texts = sorted((r.text or "")[:12] for r in rows)
    if stage is language.kept:
        assert len(rows) == 6
    elif stage is ngram_join.deduplicated:
        # One of the repeated rows and one of the long near copies go.
        assert len(rows) == len(ROWS) - 2 and texts.count("the cat sat ") == 1
    elif stage is secrets.redacted:
        assert len(rows) == len(ROWS) and sum((r.text or "").endswith("[SECRET]") for r in rows) == 1


def test_operators_take_every_row(docs):
    model = language.fit_documents(docs)
    assert language.predict(docs, model, ["doc_id"]).count() == len(ROWS)
    index = toxicity.fit(docs, docs.select("doc_id", F.lit(1).alias("toxic")))
    scored = toxicity.score(docs, index, ["doc_id"]).collect()
    assert len(scored) == len(ROWS) and all(0 <= r.score <= 1 for r in scored)
    assert bpe.encoded(docs, ["doc_id"]).agg(F.sum("n_tokens")).first()[0] > 120_000
    assert mixing.mix(mixing.sized(docs)).count() == len(ROWS)
    linked = {r.doc_id: r.component_id for r in ngram_join.linked(docs).collect()}
    assert linked[5] == 4 and linked[2] == 2 and linked[None] is None
