"""Projection, sorting, skipping and limiting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BAD_VALUE, QueryError
from ..functions import expressions
from ..functions.collation import Collation
from ..functions.paths import Scope, check_path, resolve, with_path
from .frame import Frame


def check_conflicts(paths: list[str]) -> None:
    for p in paths:
        check_path(p)
        if any(q != p and q.startswith(p + ".") for q in paths):
            raise QueryError(BAD_VALUE, f"path collision at {p}")


def _flag(v) -> bool:
    return isinstance(v, bool) or (isinstance(v, (int, float)) and v in (0, 1))


def mode(spec: dict, computed: bool = False) -> str:
    """``include`` or ``exclude`` (``all`` for none); computed fields count as inclusion."""
    if not isinstance(spec, dict):
        raise QueryError(BAD_VALUE, "projection must be a document")
    check_conflicts(list(spec))
    kinds = set()
    for k, v in spec.items():
        if not _flag(v):
            if not computed:
                raise QueryError(BAD_VALUE, f"unsupported projection value for {k}")
            expressions.check(v)
            kinds.add("include")
        elif k != "_id":
            kinds.add("include" if v else "exclude")
    if len(kinds) > 1:
        raise QueryError(BAD_VALUE, "projection cannot mix inclusion and exclusion")
    if kinds:
        return kinds.pop()
    return "all" if "_id" not in spec else "include" if spec["_id"] else "exclude"


def _tree(paths: list[str]) -> dict:
    out: dict = {}
    for p in paths:
        at = out
        for name in p.split("."):
            at = at.setdefault(name, {})
    return out


def _kept(c: Column, kind: T.DataType, tree: dict, drop: bool) -> Column:
    """The part of a value that a tree of names keeps, or all but it; names see through arrays."""
    if not tree:
        return c
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _kept(x, kind.elementType, tree, drop))
    if not isinstance(kind, T.StructType):
        return c if drop else F.lit(None)
    fields = []
    for f in kind.fields:
        if drop and not (f.name in tree and not tree[f.name]) or not drop and f.name in tree:
            fields.append(_kept(c.getField(f.name), f.dataType, tree.get(f.name, {}), drop).alias(f.name))
    return F.when(c.isNotNull(), F.struct(*fields)) if fields else F.lit(None)


def project(frame: Frame, spec: dict, computed: bool = False, by: Collation | None = None) -> Frame:
    kind = mode(spec, computed)
    if kind == "all":
        return frame
    schema, scope = frame.df.schema, Scope.of(frame.df)
    if kind == "exclude":
        tree = _tree([k for k, v in spec.items() if not v])
        names = [n for n in frame.shown() if not (n in tree and not tree[n])]
        return frame.select([_kept(F.col(f"`{n}`"), schema[n].dataType, tree.get(n, {}), True).alias(n) for n in names])
    plain = {k for k, v in spec.items() if _flag(v) and v}
    if spec.get("_id", True) and scope.has("_id"):
        plain.add("_id")
    tree = _tree(sorted(plain, key=list(dict.fromkeys(["_id", *spec])).index))
    columns = {n: _kept(F.col(f"`{n}`"), schema[n].dataType, tree[n], False) for n in frame.shown() if n in tree}
    for k, v in spec.items():
        if not _flag(v):
            c, _ = expressions.compile(v, scope, by)
            head, *rest = k.split(".")
            for name in reversed(rest):
                c = F.struct(c.alias(name))
            columns[head] = c
    return frame.select([c.alias(n) for n, c in columns.items()])


def add_fields(frame: Frame, spec: dict, by: Collation | None = None) -> Frame:
    check_conflicts(list(spec))
    scope, df = Scope.of(frame.df), frame.df
    made = {}
    for path, e in spec.items():
        c, _ = expressions.compile(e, scope, by)
        if "." not in path:
            made[path] = c
        else:
            head = path.split(".")[0]
            base = Scope(lambda n: made.get(n, F.col(f"`{n}`")), df.schema) if head not in made else None
            if base is None:  # a second path under one field: on top of the first
                df = df.withColumns(made)
                made, base = {}, Scope.of(df)
            name, new = with_path(base, path, lambda _, c=c: c)
            made[name] = new
    return Frame(df.withColumns(made), frame.order)


def unset(frame: Frame, paths: list[str]) -> Frame:
    return project(frame, dict.fromkeys(paths, 0))


def check_sort(spec: dict) -> None:
    if not isinstance(spec, dict) or not spec:
        raise QueryError(BAD_VALUE, "sort must be a non-empty document")
    for k, v in spec.items():
        check_path(k)
        if isinstance(v, bool) or v not in (1, -1):
            raise QueryError(BAD_VALUE, f"sort direction of {k} must be 1 or -1")


def sort(frame: Frame, spec: dict, by: Collation | None = None) -> Frame:
    """Puts the keys before the order so far; rows move only where order shows."""
    check_sort(spec)
    f, by = frame.numbered(), by or Collation()
    df, order = f.df, []
    for k, v in spec.items():
        value = resolve(Scope.of(df), k)
        if value is None:
            continue
        name = Frame(df).fresh()
        c = value.col
        if value.many or isinstance(value.type, T.ArrayType):
            # An array sorts by its least element ascending, by its greatest descending.
            c, kind = (F.array_min(c) if v == 1 else F.array_max(c)), value.type.elementType
        else:
            kind = value.type
        df = df.withColumn(name, by.key(c, kind))
        order.append((name, v == 1))
    tie = [("_id", True)] if "_id" in df.columns else []
    return Frame(df, (*order, *tie, *f.order))


def check_count(name: str, n) -> int:
    if isinstance(n, bool) or not isinstance(n, (int, float)) or n != int(n) or n < 0:
        raise QueryError(BAD_VALUE, f"{name} must be a non-negative integer")
    return int(n)


def window(frame: Frame, skip: int = 0, limit: int | None = None) -> Frame:
    """Rows skip to skip + limit of the order: one top-k where there is a limit."""
    f = frame.numbered()
    df = f.df.orderBy(*f.keys())
    df = df.offset(skip) if skip else df
    return Frame(df.limit(limit) if limit is not None else df, f.order)
