"""Shared pieces of the training-data operators: table access and scratch tables."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Words are runs of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Deletes a query's shuffle files as it ends; what is written needs them no more.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_made: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="sedge-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; ``clear_scratch`` deletes it."""
    path = f"{shared_dir(spark)}/sedge-{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def text_slices(batch: pa.RecordBatch, column: int, chars: int, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have about ``chars`` characters, so that few texts are Python strings at a time."""
    at, held = 0, 0
    for i, n in enumerate(pc.utf8_length(batch.column(column)).to_pylist()):
        held += n or 0
        if held >= chars or i + 1 - at >= rows or i + 1 == batch.num_rows:
            yield batch.slice(at, i + 1 - at)
            at, held = i + 1, 0


def trimmed(work):
    """A worker's function over batches that gives freed memory back to the system as a task ends.

    Workers live on from stage to stage; what one stage has freed would otherwise stay with them in the next.
    """

    @functools.wraps(work)
    def run(batches):
        try:
            yield from work(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there, and it survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def shielded(work):
    """A function of documents whose own column names can't clash with any that documents bring.

    ``work`` sees doc_id, text, lang, source and n_chars under their names and all others under names of no
    meaning; its result gets the names back. Documents may even repeat a name.
    """

    @functools.wraps(work)
    def run(docs: DataFrame) -> DataFrame:
        names, seen = docs.columns, set()
        inner = []
        for i, c in enumerate(names):
            inner.append(c if c in ("doc_id", "text", "lang", "source", "n_chars") and c not in seen else f"brought{i}")
            seen.add(c)
        return work(docs.toDF(*inner)).toDF(*names)

    return run


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_kept(df: DataFrame) -> None:
    """Delete a table made by ``keep`` that no plan reads any more."""
    for path in [p for p in _made if p in (df.inputFiles() or [""])[0]]:
        _made.remove(path)
        drop_path(df.sparkSession, path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables; for when every result that reads them has been written."""
    while _made:
        drop_path(spark, _made.pop())
