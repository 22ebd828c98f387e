"""A durable catalog of collections: versioned Parquet folders with a manifest per collection.

Manifests are numbered and never changed: a write makes a new version of the data, then
renames a complete manifest to the next number, and the highest number counts. Readers see the
old version or the new one; a writer that finds its number taken has met another writer and
fails with a write conflict. Versions that open cursors read stay until these end, and the last
few stay for readers elsewhere. All files go through Hadoop's file systems.
"""

from __future__ import annotations

import json
import re
import uuid
from collections import Counter
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import WRITE_CONFLICT, QueryError
from ..functions.paths import NULLS
from ..operators.frame import ORD

#: Versions and manifests before the newest that are kept.
KEPT = 2
_MANIFEST = re.compile(r"manifest-(\d{12})\.json$")


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._pins: Counter = Counter()
        self._stale: set[str] = set()
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # Files

    def _children(self, path: str) -> list[str]:
        p = self._path(path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p) if s.isDirectory()) if self._fs.exists(p) else []

    def _read(self, path: str) -> dict | None:
        p = self._path(path)
        if not self._fs.exists(p):
            return None
        stream = self._fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _write_new(self, path: str, doc: dict) -> None:
        """Write a file that isn't there yet, whole or not at all."""
        fresh, target = self._path(f"{path}.{uuid.uuid4().hex}"), self._path(path)
        stream = self._fs.create(fresh, True)
        stream.write(bytearray(json.dumps(doc).encode()))
        stream.close()
        if self._fs.exists(target) or not self._fs.rename(fresh, target):
            self._fs.delete(fresh, False)
            raise QueryError(WRITE_CONFLICT, "another writer has changed the collection")

    def _delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    # Collections

    def databases(self) -> list[str]:
        return [d for d in self._children(self.root) if self.collections(d)]

    def collections(self, db: str) -> list[str]:
        return [c for c in self._children(f"{self.root}/{db}") if self.manifest(db, c) is not None]

    def _numbers(self, db: str, name: str) -> list[int]:
        p = self._path(f"{self.root}/{db}/{name}")
        found = [_MANIFEST.match(x.getPath().getName()) for x in self._fs.listStatus(p)] if self._fs.exists(p) else []
        return sorted(int(m[1]) for m in found if m)

    def _manifest_path(self, db: str, name: str, n: int) -> str:
        return f"{self.root}/{db}/{name}/manifest-{n:012d}.json"

    def manifest(self, db: str, name: str) -> dict | None:
        """The newest manifest; ``n`` is its number."""
        numbers = self._numbers(db, name)
        return {**self._read(self._manifest_path(db, name, numbers[-1])), "n": numbers[-1]} if numbers else None

    def save_manifest(self, db: str, name: str, doc: dict) -> None:
        """Write the manifest after the one that ``doc`` was read as; fails if there is one already."""
        n = doc.get("n", 0) + 1
        self._write_new(self._manifest_path(db, name, n), {k: v for k, v in doc.items() if k != "n"})
        doc["n"] = n
        for old in self._numbers(db, name):
            if old < n - KEPT:
                self._delete(self._manifest_path(db, name, old))

    def create(self, db: str, name: str, validator: dict | None = None) -> dict:
        doc = {"version": None, "schema": None, "validator": validator, "indexes": []}
        self.save_manifest(db, name, doc)
        return doc

    def drop(self, db: str, name: str) -> None:
        folder = f"{self.root}/{db}/{name}"
        held = [p for p in self._pins if p.startswith(folder + "/")]
        if not held:
            self._delete(folder)
            return
        for n in self._numbers(db, name):
            self._delete(self._manifest_path(db, name, n))
        for v in self._children(folder):
            self._discard(f"{folder}/{v}")

    def drop_database(self, db: str) -> None:
        for c in self._children(f"{self.root}/{db}"):
            self.drop(db, c)
        if not any(p.startswith(f"{self.root}/{db}/") for p in self._pins):
            self._delete(f"{self.root}/{db}")

    def read(self, db: str, name: str) -> DataFrame:
        doc = self.manifest(db, name)
        if doc is None or doc["version"] is None:
            return self.spark.createDataFrame([], T.StructType([T.StructField("_id", T.StringType())]))
        schema = T.StructType.fromJson(doc["schema"])
        return self.spark.read.schema(schema).parquet(f"{self.root}/{db}/{name}/{doc['version']}")

    def pin(self, db: str, names: list[str]) -> Callable[[], None]:
        """Keep the present versions of some collections until what is returned is called."""
        docs = [(c, self.manifest(db, c)) for c in names]
        paths = [f"{self.root}/{db}/{c}/{doc['version']}" for c, doc in docs if doc and doc["version"]]
        self._pins.update(paths)

        def release() -> None:
            while paths:
                p = paths.pop()
                self._pins[p] -= 1
                if not self._pins[p]:
                    del self._pins[p]
                    if p in self._stale:
                        self._discard(p)

        return release

    def _discard(self, path: str) -> None:
        if path in self._pins:
            self._stale.add(path)
        else:
            self._stale.discard(path)
            self._delete(path)

    def replace(self, db: str, name: str, df: DataFrame, following: int | None = None, expected: int | None = None) -> None:
        """Write a new version, then point to it, then drop what is older than the last few.

        ``following`` is the next free place; ``expected`` the number of the manifest that ``df`` was made from.
        """
        doc = self.manifest(db, name) or self.create(db, name)
        if expected is not None and doc["n"] != expected:
            raise QueryError(WRITE_CONFLICT, "another writer has changed the collection")
        folder, new = f"{self.root}/{db}/{name}", uuid.uuid4().hex
        placed = df if ORD in df.columns else df.withColumn(ORD, F.monotonically_increasing_id())
        placed.write.parquet(f"{folder}/{new}")
        if ORD not in df.columns:
            following = (self.spark.read.schema(placed.schema).parquet(f"{folder}/{new}").agg(F.max(ORD)).first()[0] or 0) + 1
        before = [v for v in [doc["version"], *doc.get("before", [])] if v]
        doc |= {"version": new, "schema": json.loads(placed.schema.json()), "before": before[:KEPT], "next": doc.get("next", 0) if following is None else following}
        try:
            self.save_manifest(db, name, doc)
        except QueryError:
            self._delete(f"{folder}/{new}")
            raise
        for v in before[KEPT:]:
            self._discard(f"{folder}/{v}")


def infer(v) -> T.DataType:
    """The type of a plain value; documents keep the order of their fields."""
    import datetime as dt

    if v is None:
        return T.NullType()
    if isinstance(v, bool):
        return T.BooleanType()
    if isinstance(v, int):
        return T.IntegerType() if -(2**31) <= v < 2**31 else T.LongType()
    if isinstance(v, dict):
        return T.StructType([T.StructField(k, infer(x)) for k, x in v.items()])
    if isinstance(v, (list, tuple)):
        return T.ArrayType(reduce(merged, map(infer, v), T.NullType()))
    for cls, kind in ((float, T.DoubleType()), (str, T.StringType()), (dt.datetime, T.TimestampNTZType()), (dt.date, T.DateType()), (bytes, T.BinaryType())):
        if isinstance(v, cls):
            return kind
    raise TypeError(f"cannot store {type(v).__name__}")


def merged(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds both; documents get the fields of both, numbers the wider type."""
    from ..functions.expressions import wider

    if isinstance(a, T.NullType) or a == b:
        return b
    if isinstance(b, T.NullType):
        return a
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        kinds = {f.name: f.dataType for f in a.fields}
        for f in b.fields:
            kinds[f.name] = merged(kinds[f.name], f.dataType) if f.name in kinds else f.dataType
        return T.StructType([T.StructField(k, x) for k, x in kinds.items()])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(merged(a.elementType, b.elementType))
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return wider(a, b)
    from ..errors import BAD_VALUE

    raise QueryError(BAD_VALUE, f"a field cannot hold both {a.simpleString()} and {b.simpleString()}; use the dynamic tier")


def fitted(v, kind: T.DataType):
    """A plain value as a row of a wider type."""
    if v is None:
        return None
    if isinstance(kind, T.StructType):
        return tuple(fitted(v.get(f.name), f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return [fitted(x, kind.elementType) for x in v]
    return float(v) if isinstance(kind, T.FractionalType) else v


def frame_of(spark: SparkSession, documents: list[dict], like: T.StructType | None = None) -> DataFrame:
    kind = reduce(merged, map(infer, documents), like or T.StructType())
    return spark.createDataFrame([fitted(d, kind) for d in documents], kind)


def cast_to(c, have: T.DataType, want: T.DataType):
    """A column of one type in a type that holds it."""
    if have == want:
        return c
    if isinstance(want, T.StructType) and isinstance(have, T.StructType):
        fields = [(cast_to(c.getField(f.name), have[f.name].dataType, f.dataType) if f.name in have.fieldNames() else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(want, T.ArrayType) and isinstance(have, T.ArrayType):
        return F.transform(c, lambda x: cast_to(x, have.elementType, want.elementType))
    return c.cast(want)


def widened(df: DataFrame, kind: T.StructType) -> DataFrame:
    """A frame with the fields and types of ``kind``, which holds its own."""
    return df.select(*[(cast_to(F.col(f"`{f.name}`"), df.schema[f.name].dataType, f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in kind.fields])


def documents_of(df: DataFrame) -> list[dict]:
    """Rows as plain documents without their missing fields."""
    return [document(r) for r in df.collect()]


def document(v, nulls: frozenset[str] = frozenset(), prefix: str = ""):
    from pyspark.sql import Row

    if isinstance(v, Row):
        if NULLS in v.__fields__:
            nulls = frozenset(v[NULLS] or ())
        return {k: document(x, nulls, f"{prefix}{k}.") for k, x in zip(v.__fields__, v, strict=True) if k != NULLS and (x is not None or prefix + k in nulls)}
    return [document(x) for x in v] if isinstance(v, list) else v
