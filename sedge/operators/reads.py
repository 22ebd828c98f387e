"""find, count and distinct over frames."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import filters
from ..functions.collation import Collation
from ..functions.paths import NULLS, Scope, check_path, resolve
from . import shaping
from .frame import ORD, Frame

#: Rows of a cursor's first page, and of its later pages at most.
FIRST_PAGE, MOST_PAGE = 128, 16_384


def find(df: DataFrame, query: dict | None = None, projection: dict | None = None, sort: dict | None = None, skip: int = 0, limit: int = 0, collation=None, ordered: bool = False, nulls: bool = False) -> DataFrame:
    """Filter, sort, skip, limit, project; a limit of 0 is none."""
    by = Collation.parse(collation)
    skip, limit = shaping.check_count("skip", skip), shaping.check_count("limit", limit)
    if projection:
        shaping.mode(projection)
    frame = Frame(df).where(filters.matches(query or {}, Scope.of(df), by, two_valued=False))
    if sort:
        frame = shaping.sort(frame, sort, by)
    if skip or limit:
        frame = shaping.window(frame, skip, limit or None)
    if ordered:
        frame = frame.numbered()
    return (shaping.project(frame, projection) if projection else frame).result(ordered, nulls)


def pages(df: DataFrame, query: dict, projection: dict | None, collation=None) -> Iterator[Row]:
    """Rows of a stored collection in its order, page by page: each page is a top-k beyond the last place read, and nothing is sorted as a whole."""
    frame = Frame(df).numbered().where(filters.matches(query, Scope.of(df), Collation.parse(collation), two_valued=False))
    frame = shaping.project(frame, projection) if projection else frame
    shown, rows, last = [*frame.shown(), *[c for c in frame.hidden() if c == NULLS]], FIRST_PAGE, -1
    while True:
        got = frame.df.where(F.col(ORD) > last).orderBy(ORD).limit(rows).select(*[F.col(f"`{c}`") for c in shown], ORD).collect()
        for r in got:
            yield Row(*shown)(*r[:-1])
        if len(got) < rows:
            return
        last, rows = got[-1][-1], min(MOST_PAGE, 4 * rows)


def count(df: DataFrame, query: dict | None = None, skip: int = 0, limit: int = 0, collation=None) -> DataFrame:
    """One row n. Skips and limits are arithmetic on the count: no rows move."""
    skip, limit = shaping.check_count("skip", skip), shaping.check_count("limit", limit)
    n = F.greatest(F.count(F.lit(1)) - skip, F.lit(0))
    found = df.where(filters.matches(query or {}, Scope.of(df), Collation.parse(collation), two_valued=False))
    return found.agg((F.least(n, F.lit(limit)) if limit else n).cast("long").alias("n"))


def distinct(df: DataFrame, field: str, query: dict | None = None, collation=None) -> DataFrame:
    """One column ``value``: distinct values, array elements each, missing ones left out. Collated strings keep the first seen."""
    check_path(field)
    by = Collation.parse(collation)
    found = df.where(filters.matches(query or {}, Scope.of(df), by, two_valued=False))
    v = resolve(Scope.of(found), field)
    if v is None:
        return found.sparkSession.createDataFrame([], "value string")
    c, kind = v.col, v.type
    if by.folds:
        found, key = (f := Frame(found).numbered()).df, f.order[0][0]
    keep = [key] if by.folds else []
    out = found.select(c.alias("value"), *keep)
    while isinstance(kind, T.ArrayType):
        out, kind = out.select(F.explode("value").alias("value"), *keep), kind.elementType
    out = out.where("value is not null")
    if by.folds and isinstance(kind, T.StringType):
        return out.groupBy(by.key(F.col("value"), kind).alias("__k")).agg(F.min_by("value", key).alias("value")).select("value")
    return out.select("value").distinct()
