"""The dynamic tier: heterogeneous documents in a VARIANT column, matched without one schema.

A frame has ``_id``, ``_ord`` and ``doc``. VARIANT values can't be compared, grouped or sorted,
so that all three go through a key: a rank by type, a number, and a string, in the
cross-type order null < number < string < object < array < bool < date.
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BAD_VALUE, QueryError
from . import filters
from .filters import BOUNDS, LOGICAL, is_number, is_operators, java_regex, sure
from .paths import check_path

RANKS = {"null": 0, "number": 1, "string": 2, "object": 3, "array": 4, "bool": 6, "date": 7}
_KIND = {"int": "^(TINYINT|SMALLINT|INT|BIGINT)$", "long": "^BIGINT$", "double": "^(DOUBLE|FLOAT|DECIMAL.*)$", "string": "^STRING$", "bool": "^BOOLEAN$", "null": "^VOID$", "object": "^OBJECT", "array": "^ARRAY", "date": "^(TIMESTAMP|DATE)"}


def frame(spark: SparkSession, documents: list[dict]) -> DataFrame:
    rows = [(json.dumps(d.get("_id")), i, json.dumps(d)) for i, d in enumerate(documents)]
    return spark.createDataFrame(rows, "_id string, _ord long, json string").select("_id", "_ord", F.parse_json("json").alias("doc"))


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def rank(v: Column) -> Column:
    k = kind(v)
    out = F.when(v.isNull() | (k == "VOID"), RANKS["null"])
    for name, n in (("int", 1), ("double", 1), ("string", 2), ("object", 3), ("array", 4), ("bool", 6), ("date", 7)):
        out = out.when(k.rlike(_KIND[name]), n)
    return out.otherwise(8)


def key(v: Column) -> Column:
    """Equal for equal values, whatever the widths of their numbers, and ordered by the cross-type order."""
    r = rank(v)
    whole = F.when(kind(v).rlike(_KIND["int"]), F.try_variant_get(v, "$", "bigint"))
    text = F.when(r == 2, F.try_variant_get(v, "$", "string")).when((r > 2) & (r != 6), F.to_json(v)).when(r == 6, v.cast("string"))
    return F.struct(r.alias("rank"), F.when(r == 1, F.try_variant_get(v, "$", "double")).alias("num"), F.when(F.abs(whole) > (1 << 53), whole).alias("wide"), text.alias("str"))


def literal_key(x) -> Column:
    return key(F.parse_json(F.lit(json.dumps(x))))


def at(doc: Column, path: str) -> list[Column]:
    """The array of what a dotted path meets, through arrays of documents."""
    check_path(path)
    found = F.array(doc)
    for name in path.split("."):
        found = F.filter(_stepped(found, "$['" + name.replace("'", "\\'") + "']"), lambda v: v.isNotNull())
    return found


def _elements(v: Column) -> Column:
    return F.coalesce(F.when(kind(v).rlike("^ARRAY"), F.try_variant_get(v, "$", "array<variant>")), F.array().cast("array<variant>"))


def _stepped(found: Column, step: str) -> Column:
    return F.flatten(F.transform(found, lambda v: F.concat(F.array(F.try_variant_get(v, step, "variant")), F.transform(_elements(v), lambda e: F.try_variant_get(e, step, "variant")))))


def _members(found: Column) -> Column:
    """Values and, of arrays, their elements."""
    return F.flatten(F.transform(found, lambda v: F.concat(F.array(v), _elements(v))))


def matches(query: dict, doc: Column) -> Column:
    """A filter document over a VARIANT column: the same language as the typed tier, without collation."""
    filters.parse(query)
    return _document(query, doc)


def _document(query: dict, doc: Column) -> Column:
    tests = []
    for k, v in query.items():
        if k in LOGICAL:
            each = [_document(x, doc) for x in v]
            joined = reduce((lambda a, b: a & b) if k == "$and" else (lambda a, b: a | b), each)
            tests.append(~joined if k == "$nor" else joined)
        else:
            tests.append(_field(at(doc, k), v if is_operators(v) else {"$regex": v} if isinstance(v, re.Pattern) else {"$eq": v}))
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


def _any(found: Column, test) -> Column:
    return sure(F.exists(_members(found), lambda v: sure(test(v))))


def _equal(found: Column, x) -> Column:
    if x is None:
        return (F.size(found) == 0) | _any(found, lambda v: rank(v) == 0)
    return _any(found, lambda v: key(v) == literal_key(x))


def _field(found: Column, spec: dict) -> Column:
    tests = [_test(found, op, x, spec) for op, x in spec.items() if op != "$options"]
    return reduce(lambda a, b: a & b, tests)


def _test(found: Column, op: str, x, spec: dict) -> Column:
    if op in ("$ne", "$nin"):
        return ~_field(found, {"$eq" if op == "$ne" else "$in": x})
    if op == "$not":
        return ~_field(found, {"$regex": x} if isinstance(x, re.Pattern) else x)
    if op == "$eq":
        return _equal(found, x)
    if op == "$in":
        return reduce(lambda a, b: a | b, [_equal(found, y) for y in x], F.lit(False))
    if op == "$exists":
        return (F.size(found) > 0) if x else (F.size(found) == 0)
    if op in BOUNDS:
        r = RANKS["bool" if isinstance(x, bool) else "number" if is_number(x) else "string"]
        return _any(found, lambda v: (rank(v) == r) & getattr(key(v), BOUNDS[op])(literal_key(x)))
    if op == "$regex":
        p = java_regex(x, spec.get("$options", ""))
        return _any(found, lambda v: (rank(v) == 2) & F.try_variant_get(v, "$", "string").rlike(p))
    if op == "$type":
        names = [n for n in filters._types(x) if n in _KIND]
        return _any(found, lambda v: reduce(lambda a, b: a | b, [kind(v).rlike(_KIND[n]) for n in names], F.lit(False)))
    if op == "$size":
        return sure(F.exists(found, lambda v: kind(v).rlike("^ARRAY") & (F.size(_elements(v)) == x)))
    if op == "$all":
        each = [_field(found, e) if is_operators(e) else _equal(found, e) for e in x]
        return reduce(lambda a, b: a & b, each) if each else F.lit(False)
    if op == "$elemMatch":
        plain = is_operators(x) and not any(k in LOGICAL for k in x)
        return sure(F.exists(found, lambda v: F.exists(_elements(v), lambda e: _field(F.array(e), x) if plain else _document(x, e))))
    raise QueryError(BAD_VALUE, f"unsupported query operator {op}")


def find(df: DataFrame, query: dict) -> DataFrame:
    return df.where(matches(query, F.col("doc")))


def value(path: str) -> Column:
    """The first value that a path meets."""
    return F.get(at(F.col("doc"), path), F.lit(0))


def group_count(df: DataFrame, path: str) -> DataFrame:
    """(value, n) by whole values, numbers across widths, in first-seen order."""
    rows = df.select(value(path).alias("v"), "_ord")
    out = rows.groupBy(key(F.col("v")).alias("k")).agg(F.min_by("v", "_ord").alias("value"), F.count(F.lit(1)).alias("n"), F.min("_ord").alias("first"))
    return out.orderBy("first").select("value", "n")


def sort(df: DataFrame, path: str, ascending: bool = True) -> DataFrame:
    k = key(value(path))
    return df.withColumn("__k", k).orderBy(F.col("__k").asc() if ascending else F.col("__k").desc(), "_ord").drop("__k")


def least(df: DataFrame, path: str) -> DataFrame:
    """The least and greatest present values in the cross-type order."""
    present = df.select(value(path).alias("v")).where("v is not null")
    return present.agg(F.min_by("v", key(F.col("v"))).alias("least"), F.max_by("v", key(F.col("v"))).alias("greatest"))
