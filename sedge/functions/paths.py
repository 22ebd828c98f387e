"""Dotted paths over a typed schema: how a path reads, fans out over arrays, and is written."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BAD_VALUE, QueryError


@dataclass(frozen=True)
class Scope:
    """Named fields of a row, or of a struct within one."""

    get: Callable[[str], Column]
    schema: T.StructType

    @staticmethod
    def of(df: DataFrame) -> Scope:
        return Scope(lambda n: F.col(f"`{n}`"), df.schema)

    @staticmethod
    def inside(c: Column, schema: T.StructType) -> Scope:
        return Scope(lambda n: c.getField(n), schema)

    def has(self, name: str) -> bool:
        return name in self.schema.fieldNames()

    def root(self) -> Column:
        return F.struct(*[self.get(f.name).alias(f.name) for f in self.schema.fields if not f.name.startswith("__")])


@dataclass(frozen=True)
class Value:
    """A resolved path. ``many``: it went through arrays, and ``col`` holds the array of what it met."""

    col: Column
    type: T.DataType
    many: bool = False


MISSING = None
#: Paths at which a stored document holds an explicit null; a null cell alone is a missing field.
NULLS = "__null"


def explicit_null(scope: Scope, path: str) -> Column:
    """Whether a stored document holds null at a path."""
    return F.coalesce(F.array_contains(scope.get(NULLS), path), F.lit(False)) if scope.has(NULLS) else F.lit(False)


def null_paths(document: dict, prefix: str = "") -> list[str]:
    out: list[str] = []
    for k, v in document.items():
        if v is None:
            out.append(prefix + k)
        elif isinstance(v, dict):
            out += null_paths(v, f"{prefix}{k}.")
    return out


def check_path(path: str) -> list[str]:
    if not isinstance(path, str) or not path or any(not p or p.startswith("$") for p in path.split(".")):
        raise QueryError(BAD_VALUE, f"invalid field path {path!r}")
    return path.split(".")


def resolve(scope: Scope, path: str) -> Value | None:
    """The value of a path, or None where the schema has no such field."""
    parts = path.split(".")
    if not scope.has(parts[0]):
        return MISSING
    value = Value(scope.get(parts[0]), scope.schema[parts[0]].dataType)
    for name in parts[1:]:
        value = _step(value, name)
        if value is None:
            return MISSING
    return value


def _step(v: Value, name: str) -> Value | None:
    kind, many = (v.type.elementType if v.many else v.type), v.many
    if isinstance(kind, T.ArrayType) and name.isdigit():
        at = int(name)
        if many:
            return Value(F.transform(v.col, lambda x: F.get(x, F.lit(at))), T.ArrayType(kind.elementType), True)
        return Value(F.get(v.col, F.lit(at)), kind.elementType)
    col = v.col
    if isinstance(kind, T.ArrayType):
        col, kind, many = (F.flatten(col) if many else col), kind.elementType, True
    if not isinstance(kind, T.StructType) or name not in kind.fieldNames():
        return None
    field = kind[name].dataType
    if many:
        return Value(F.transform(col, lambda x: x.getField(name)), T.ArrayType(field), True)
    return Value(col.getField(name), field)


def with_path(scope: Scope, path: str, make: Callable[[Scope], Column | None]) -> tuple[str, Column | None]:
    """(top field, its new column) with ``path`` set to what ``make`` gives for its parent; None drops it."""
    head, *rest = path.split(".")
    if not rest:
        return head, make(scope)
    kind = scope.schema[head].dataType if scope.has(head) else None
    if kind is None or isinstance(kind, T.NullType):
        inner = make(Scope.inside(F.lit(None), T.StructType()))
        for name in reversed(rest):
            inner = F.struct(inner.alias(name)) if inner is not None else None
        return head, inner
    return head, _set(scope.get(head), kind, rest, make)


def _set(c: Column, kind: T.DataType, rest: list[str], make) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _set(x, kind.elementType, rest, make))
    if not isinstance(kind, T.StructType):
        raise QueryError(BAD_VALUE, f"cannot create field {rest[0]!r} in a scalar parent")
    inner = Scope.inside(c, kind)
    name, new = with_path(inner, ".".join(rest), make)
    fields = [(f.name, new if f.name == name else c.getField(f.name)) for f in kind.fields]
    if not inner.has(name):
        fields.append((name, new))
    fields = [(n, x) for n, x in fields if x is not None]
    if not fields:
        return F.lit(None)
    built = F.struct(*[x.alias(n) for n, x in fields])
    return F.when(c.isNotNull() | F.lit(new is not None), built)


def set_path(df: DataFrame, path: str, make: Callable[[Scope], Column | None]) -> DataFrame:
    name, new = with_path(Scope.of(df), path, make)
    return df.drop(name) if new is None else df.withColumn(name, new)
