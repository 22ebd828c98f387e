"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and gives a table that is written as Parquet and
read again as the next stage's docs. All but the last give the columns of documents:

1. language: documents of no language, or of none that holds them together, go;
2. near duplicates: one document of each group of similar shingle sets stays;
3. secrets: spans that patterns or the randomness battery find are masked;
4. mixing: documents are used as often as the sources' target weights take them;
5. tokens: texts become token ids, with digests of ids and decoded text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sedge.llm import bpe, common, language, mixing, ngram_join, secrets

_scratch: list[str] = []


def _stage(work):
    """A stage first deletes the scratch tables of the one before it, whose result has been written by then."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _scratch:
            path = _scratch.pop()
            if path in common._made:
                common._made.remove(path)
                common.drop_path(spark, path)
        before = set(common._made)
        out = work(docs)
        _scratch.extend(p for p in common._made if p not in before)
        return out

    return run_stage


def _tokens(docs: DataFrame) -> DataFrame:
    return bpe.encoded(docs, ["doc_id", "lang", "source"], with_ids=True).drop("decoded")


STAGES = [
    ("language", _stage(language.kept)),
    ("near_duplicates", _stage(ngram_join.deduplicated)),
    ("secrets", _stage(secrets.redacted)),
    ("mixing", _stage(mixing.mixed_documents)),
    ("tokens", _stage(_tokens)),
]
#: Learned models, seeded choices and merges: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    written = None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = f"{common.shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            if written:
                common.drop_path(spark, written)
            written, docs = path, spark.read.parquet(path)
    return docs
