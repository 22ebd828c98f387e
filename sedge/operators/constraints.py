"""Constraints on collections: unique, sparse and partial keys, expiry and schema validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import FAILED_TO_PARSE, INVALID_OPTIONS, QueryError
from ..functions import filters
from ..functions.collation import Collation
from ..functions.paths import Scope, check_path, explicit_null, resolve

BSON_TYPES = {"object", "array", "string", "int", "long", "double", "number", "bool", "objectId", "date", "null"}


def check_partial(spec: dict) -> None:
    """Partial filters: equality of non-numeric scalars, $eq, $exists: true and $and."""
    if not isinstance(spec, dict) or not spec:
        raise QueryError(INVALID_OPTIONS, "partialFilterExpression must be a non-empty document")
    for k, v in spec.items():
        if k == "$and":
            for x in v:
                check_partial(x)
            continue
        for op, x in (v.items() if filters.is_operators(v) else [("$eq", v)]):
            if op not in ("$eq", "$exists") or (op == "$exists" and x is not True):
                raise QueryError(INVALID_OPTIONS, f"partialFilterExpression operator {op} is not supported")
            if op == "$eq" and (filters.is_number(x) or isinstance(x, (dict, list))):
                raise QueryError(INVALID_OPTIONS, "partialFilterExpression requires a non-numeric scalar")


def members(df: DataFrame, keys: list[str], sparse: bool = False, partial: dict | None = None) -> DataFrame:
    """The documents that an index holds."""
    if partial:
        check_partial(partial)
        df = df.where(filters.matches(partial, Scope.of(df), two_valued=False))
    if sparse:
        for k in keys:
            v = resolve(Scope.of(df), k)
            df = df.where((v.col.isNotNull() if v is not None else F.lit(False)) | explicit_null(Scope.of(df), k))
    return df


def unique_violations(df: DataFrame, keys: list[str], sparse: bool = False, partial: dict | None = None, collation=None) -> DataFrame:
    """(keys, n) of key values that more than one document has; missing and null are one value."""
    by, scope = Collation.parse(collation), Scope.of(df)
    columns = []
    for k in keys:
        check_path(k)
        v = resolve(scope, k)
        if v is not None and (v.many or isinstance(v.type, T.ArrayType)):
            raise QueryError(INVALID_OPTIONS, f"unique index on {k} does not support array values")
        columns.append((by.key(v.col, v.type) if v is not None else F.lit(None)).alias(k.replace(".", "_")))
    return members(df, keys, sparse, partial).groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def live(df: DataFrame, field: str, seconds: float, now) -> DataFrame:
    """Documents that have not expired: only a plain date at or before now less the seconds expires."""
    v = resolve(Scope.of(df), field)
    if v is None or v.many or not isinstance(v.type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return df
    limit = F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {float(seconds)} seconds")
    return df.where(~filters.sure(v.col.cast("timestamp_ntz") <= limit))


def check_validator(spec) -> dict:
    """The root of a $jsonSchema validator; every part that isn't supported is an error."""
    if not isinstance(spec, dict) or list(spec) != ["$jsonSchema"]:
        raise QueryError(INVALID_OPTIONS, "validator supports only $jsonSchema")
    root = spec["$jsonSchema"]
    _check_schema(root, True)
    return root


def _check_schema(s, root: bool = False) -> None:
    if not isinstance(s, dict):
        raise QueryError(FAILED_TO_PARSE, "a schema must be a document")
    kinds = s.get("bsonType", "object" if root else None)
    for k in [] if kinds is None else kinds if isinstance(kinds, list) else [kinds]:
        if k not in BSON_TYPES:
            raise QueryError(INVALID_OPTIONS, f"bsonType {k} is not supported")
    if root and kinds != "object":
        raise QueryError(INVALID_OPTIONS, "the root bsonType must be object")
    for k, v in s.items():
        if k == "required":
            if not isinstance(v, list) or not v or not all(isinstance(x, str) for x in v):
                raise QueryError(FAILED_TO_PARSE, "required must be an array of names")
        elif k == "properties":
            if not isinstance(v, dict):
                raise QueryError(FAILED_TO_PARSE, "properties must be a document")
            for name, x in v.items():
                if "." in name:
                    raise QueryError(INVALID_OPTIONS, f"property names must not contain dots: {name}")
                _check_schema(x)
        elif k != "bsonType":
            raise QueryError(INVALID_OPTIONS, f"schema keyword {k} is not supported")


def valid(spec: dict, df: DataFrame) -> Column:
    """Whether a document satisfies a validator."""
    return _valid(check_validator(spec), Scope.of(df), Scope.of(df))


def _valid(s: dict, scope: Scope, whole: Scope, prefix: str = "") -> Column:
    tests = [(scope.get(n).isNotNull() if scope.has(n) else F.lit(False)) | explicit_null(whole, prefix + n) for n in s.get("required", [])]
    for name, x in s.get("properties", {}).items():
        kinds = x.get("bsonType")
        if kinds is not None and "null" not in (kinds if isinstance(kinds, list) else [kinds]):
            tests.append(~explicit_null(whole, prefix + name))
        if not scope.has(name):
            continue
        c, field = scope.get(name), scope.schema[name]
        own = filters.type_name(field.dataType, field.metadata)
        fits = kinds is None or any(k == own or (k == "number" and own in ("int", "long", "double")) for k in (kinds if isinstance(kinds, list) else [kinds]))
        test = F.lit(fits)
        if fits and isinstance(field.dataType, T.StructType):
            test = _valid(x, Scope.inside(c, field.dataType), whole, f"{prefix}{name}.")
        tests.append(c.isNull() | test)
    return reduce(lambda a, b: a & b, tests, F.lit(True))
