"""Aggregation pipelines: stages in order, each from a Frame to a Frame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BAD_VALUE, FAILED_TO_PARSE, INVALID_OPTIONS, QueryError
from ..functions import expressions, filters
from ..functions.collation import Collation
from ..functions.paths import NULLS, Scope, check_path, resolve, with_path
from . import shaping
from .frame import ORD, Frame

ACCUMULATORS = ("$sum", "$avg", "$min", "$max", "$first", "$last", "$push", "$addToSet")
ORDERED = {"$first", "$last", "$push", "$addToSet"}
STAGES = {"$match", "$sort", "$skip", "$limit", "$count", "$project", "$addFields", "$set", "$unset", "$replaceRoot", "$replaceWith", "$unwind", "$group", "$lookup"}


def parse(pipeline) -> list[tuple[str, object]]:
    """(stage, specification) pairs; raises all errors that need no data."""
    if not isinstance(pipeline, list):
        raise QueryError(FAILED_TO_PARSE, "pipeline must be an array")
    out = []
    for stage in pipeline:
        if not isinstance(stage, dict) or len(stage) != 1:
            raise QueryError(FAILED_TO_PARSE, "a pipeline stage must be a document of one field")
        name, spec = next(iter(stage.items()))
        if name not in STAGES:
            raise QueryError(INVALID_OPTIONS, f"aggregation stage {name} is not supported")
        _check(name, spec)
        out.append((name, spec))
    return out


def _check(name: str, spec) -> None:
    if name == "$match":
        filters.parse(spec)
    elif name == "$sort":
        shaping.check_sort(spec)
    elif name in ("$skip", "$limit"):
        if shaping.check_count(name, spec) == 0 and name == "$limit":
            raise QueryError(BAD_VALUE, "$limit must be positive")
    elif name == "$count":
        if not isinstance(spec, str) or not spec or spec.startswith("$") or "." in spec:
            raise QueryError(FAILED_TO_PARSE, "$count requires a plain field name")
    elif name == "$project":
        if not spec:
            raise QueryError(FAILED_TO_PARSE, "$project requires a non-empty document")
        shaping.mode(spec, computed=True)
    elif name in ("$addFields", "$set"):
        if not isinstance(spec, dict) or not spec:
            raise QueryError(FAILED_TO_PARSE, f"{name} requires a non-empty document")
        shaping.check_conflicts(list(spec))
        for e in spec.values():
            expressions.check(e)
    elif name == "$unset":
        paths = spec if isinstance(spec, list) else [spec]
        if not paths:
            raise QueryError(FAILED_TO_PARSE, "$unset requires field paths")
        shaping.check_conflicts(paths)
    elif name in ("$replaceRoot", "$replaceWith"):
        if name == "$replaceRoot" and (not isinstance(spec, dict) or list(spec) != ["newRoot"]):
            raise QueryError(FAILED_TO_PARSE, "$replaceRoot requires newRoot")
        e = spec["newRoot"] if name == "$replaceRoot" else spec
        expressions.check(e)
        if expressions.is_constant(e) and not isinstance(expressions.constant(e), dict):
            raise QueryError(BAD_VALUE, f"{name} requires a document")
    elif name == "$unwind":
        _unwind_spec(spec)
    elif name == "$group":
        _check_group(spec)
    else:
        _check_lookup(spec)


def _check_group(spec) -> None:
    if not isinstance(spec, dict) or "_id" not in spec:
        raise QueryError(FAILED_TO_PARSE, "$group requires _id")
    expressions.check(spec["_id"])
    if expressions.operator_of(spec["_id"]) in ACCUMULATORS:
        raise QueryError(BAD_VALUE, "$group _id cannot be an accumulator")
    for k, acc in spec.items():
        if k == "_id":
            continue
        if "." in k or k.startswith("$") or not isinstance(acc, dict) or len(acc) != 1:
            raise QueryError(FAILED_TO_PARSE, f"$group field {k} requires one accumulator")
        op, e = next(iter(acc.items()))
        if op not in ACCUMULATORS:
            raise QueryError(BAD_VALUE, f"$group accumulator {op} is not supported")
        expressions.check(e)
        if expressions.is_constant(e):
            v = expressions.constant(e)
            if op == "$avg" or (op == "$sum" and not filters.is_number(v)):
                raise QueryError(BAD_VALUE, f"$group {op} does not support constant {v!r}")


def _check_lookup(spec) -> None:
    if not isinstance(spec, dict):
        raise QueryError(FAILED_TO_PARSE, "$lookup requires a document")
    for k in spec:
        if k not in ("from", "localField", "foreignField", "as"):
            raise QueryError(INVALID_OPTIONS, f"$lookup {k} is not supported")
    for k in ("from", "localField", "foreignField", "as"):
        if not isinstance(spec.get(k), str) or not spec[k]:
            raise QueryError(FAILED_TO_PARSE, f"$lookup requires {k}")
        if k != "from":
            check_path(spec[k])


def _unwind_spec(spec) -> tuple[str, bool, str | None]:
    doc = {"path": spec} if isinstance(spec, str) else spec
    if not isinstance(doc, dict) or any(k not in ("path", "preserveNullAndEmptyArrays", "includeArrayIndex") for k in doc):
        raise QueryError(FAILED_TO_PARSE, "$unwind requires a path")
    path, keep, index = doc.get("path"), doc.get("preserveNullAndEmptyArrays", False), doc.get("includeArrayIndex")
    if not isinstance(path, str) or not path.startswith("$") or len(path) < 2:
        raise QueryError(FAILED_TO_PARSE, "$unwind path must begin with $")
    check_path(path[1:])
    if not isinstance(keep, bool):
        raise QueryError(FAILED_TO_PARSE, "$unwind preserveNullAndEmptyArrays must be a boolean")
    if index is not None:
        check_path(index)
    return path[1:], keep, index


def aggregate(source: DataFrame | Frame, pipeline: list, lookup: Callable[[str], DataFrame] | None = None, collation=None, ordered: bool = False, nulls: bool = False) -> DataFrame:
    """Run a pipeline. ``lookup`` gives foreign collections by name; ``ordered`` sorts the result by the stream's order."""
    stages, by = parse(pipeline), Collation.parse(collation)
    frame = source if isinstance(source, Frame) else Frame(source)
    fused = False
    for i, (name, spec) in enumerate(stages):
        if fused:
            fused = False
            continue
        if name == "$lookup" and i + 1 < len(stages) and (keep := _unwinds(stages[i + 1], spec["as"])) is not None:
            # The list that would be unwound at once is never made: the join's rows are the result.
            joined = look_up(frame, spec, lookup, by, keep)
            if joined is not None:
                frame, fused = joined, True
                continue
        frame = _run(frame, name, spec, lookup, by, ordered or _order_shows(stages[i + 1 :]))
    if ordered and frame.order is None and ORD in frame.df.columns:
        frame = frame.numbered()
    return frame.result(ordered, nulls)


def _unwinds(stage: tuple[str, object], path: str) -> bool | None:
    """Whether a stage that unwinds ``path`` keeps rows without elements; None where it does something else."""
    name, spec = stage
    if name != "$unwind":
        return None
    own, keep, index = _unwind_spec(spec)
    return keep if own == path and index is None else None


def _order_shows(rest: list[tuple[str, object]]) -> bool:
    """Whether a later stage, before the next sort, depends on the order of its input."""
    for name, spec in rest:
        if name in ("$skip", "$limit") or (name == "$group" and any(op in ORDERED for k, a in spec.items() if k != "_id" for op in a)):
            return True
        if name in ("$count", "$sort"):
            return False
    return False


def _run(frame: Frame, name: str, spec, lookup, by: Collation, shows: bool) -> Frame:
    if name == "$match":
        return frame.where(filters.matches(spec, Scope.of(frame.df), by, two_valued=False))
    if name == "$sort":
        return shaping.sort(frame, spec, by)
    if name == "$skip":
        return shaping.window(frame, skip=int(spec))
    if name == "$limit":
        return shaping.window(frame, limit=int(spec))
    if name == "$count":
        return Frame(frame.df.agg(F.count(F.lit(1)).alias(spec)).where(F.col(f"`{spec}`") > 0), ())
    if name == "$project":
        return shaping.project(frame, spec, computed=True, by=by)
    if name in ("$addFields", "$set"):
        return shaping.add_fields(frame, spec, by)
    if name == "$unset":
        return shaping.unset(frame, spec if isinstance(spec, list) else [spec])
    if name in ("$replaceRoot", "$replaceWith"):
        return replace_root(frame, spec["newRoot"] if name == "$replaceRoot" else spec, by)
    if name == "$unwind":
        return unwind(frame, *_unwind_spec(spec))
    if name == "$group":
        return group(frame, spec, by, shows)
    return look_up(frame, spec, lookup, by)


def replace_root(frame: Frame, e, by: Collation) -> Frame:
    c, kind = expressions.compile(e, Scope.of(frame.df), by)
    if not isinstance(kind, T.StructType):
        raise QueryError(BAD_VALUE, "replacement root must be a document")
    fine = F.when(c.isNotNull(), c).otherwise(F.raise_error(F.lit("replacement root must be a document")))
    hidden = [c for c in frame.hidden() if c != NULLS]
    df = frame.df.select(fine.alias("__root"), *hidden)
    return Frame(df.select(*[F.col("__root").getField(f.name).alias(f.name) for f in kind.fields], *hidden), frame.order)


def unwind(frame: Frame, path: str, keep: bool, index: str | None) -> Frame:
    scope = Scope.of(frame.df)
    value = resolve(scope, path)
    if value is None:
        frame = frame if keep else frame.where(F.lit(False))
        return shaping.add_fields(frame, {index: {"$literal": None}}) if index else frame
    if not isinstance(value.type, T.ArrayType):
        frame = frame if keep else frame.where(value.col.isNotNull())
        return Frame(frame.df.withColumn(index, F.lit(None).cast("int")), frame.order) if index else frame
    pos, item = frame.fresh() + "p", "__item"
    df = frame.df.select("*", (F.posexplode_outer if keep else F.posexplode)(value.col).alias(pos, item))
    name, new = with_path(Scope.of(df), path, lambda _: F.col(item))
    df = df.withColumn(name, new)
    if index:
        df = df.withColumn(index, F.col(pos))
    stored = frame.order is None and ORD in frame.df.columns
    order = ((ORD, True), (pos, True)) if stored else None if frame.order is None else (*frame.order, (pos, True))
    if order is None:  # the scan's order holds after a generator; positions need not be kept
        df = df.drop(pos)
    return Frame(df.drop(item), order)


def _accumulator(op: str, c: Column, kind: T.DataType, key: Column | None) -> Column:
    number = c if isinstance(kind, T.NumericType) else F.lit(None).cast("double")
    if op == "$sum":
        return F.coalesce(F.sum(number), F.lit(0))
    if op == "$avg":
        return F.avg(number)
    if op in ("$min", "$max"):
        return (F.min if op == "$min" else F.max)(c)
    if op in ("$first", "$last"):
        return (F.min_by if op == "$first" else F.max_by)(F.struct(c.alias("v")), key).getField("v")
    return F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), c.alias("v")))), lambda x: x["v"])


def _sets(df: DataFrame, group_id: Column, key: Column, values: dict[str, Column]) -> list[DataFrame]:
    """(_id, set) for each $addToSet: values are made unique before any list is, in the order in which they were first seen."""
    out = []
    for k, c in values.items():
        first = df.groupBy(group_id.alias("_id"), c.alias("__v")).agg(F.min(key).alias("__k"))
        listed = F.array_sort(F.collect_list(F.struct(F.col("__k").alias("k"), F.col("__v").alias("v"))))
        out.append(first.groupBy("_id").agg(F.transform(listed, lambda x: x["v"]).alias(k)))
    return out


def group(frame: Frame, spec: dict, by: Collation, shows: bool) -> Frame:
    """Groups by the values of _id; the order of groups (first seen first) is made only where it shows."""
    key = None
    if shows or any(op in ORDERED for k, a in spec.items() if k != "_id" for op in a):
        frame, key = frame.rising()
    scope = Scope.of(frame.df)
    group_id, _ = expressions.compile(spec["_id"], scope, by)
    made, sets = [], {}
    for k, acc in spec.items():
        if k == "_id":
            continue
        op, e = next(iter(acc.items()))
        if op == "$sum" and filters.is_number(e):
            made.append((F.count(F.lit(1)) * e).alias(k))
            continue
        c, kind = expressions.compile(e, scope, by)
        if op == "$addToSet":
            sets[k] = c
            continue
        made.append(_accumulator(op, c, kind, key).alias(k))
    first = [F.min(key).alias(frame.fresh() + "g")] if shows else []
    if sets:
        parts = _sets(frame.df, group_id, key, sets)
        if made or first:
            parts.append(frame.df.groupBy(group_id.alias("_id")).agg(*made, *first))
        df = parts[0]
        for other in parts[1:]:
            df = df.withColumnRenamed("_id", "__g").join(other, F.col("__g").eqNullSafe(F.col("_id"))).drop("__g")
        place = [c for c in df.columns if c.startswith("__")]
        return Frame(df.select("_id", *[f"`{k}`" for k in spec if k != "_id"], *place), ((place[-1], True),) if shows else ())
    if not made and not first:
        return Frame(frame.df.groupBy(group_id.alias("_id")).agg(F.count(F.lit(1)).alias("__n")).drop("__n"), ())
    df = frame.df.groupBy(group_id.alias("_id")).agg(*made, *first)
    return Frame(df, ((df.columns[-1], True),) if shows else ())


def look_up(frame: Frame, spec: dict, lookup, by: Collation, unwound: bool | None = None) -> Frame | None:
    """Left-outer nest join on equality, missing and null alike; foreign documents in their own order.

    Keys that are arrays, on either side, are exploded, so that the join is on plain keys. Only foreign
    documents that some key asks for are gathered. ``unwound`` (not None) gives a row per match instead of
    lists, with or without rows of no match; None is returned where local keys are arrays.
    """
    if lookup is None:
        raise QueryError(INVALID_OPTIONS, "$lookup needs a catalog of collections")
    foreign = lookup(spec["from"])
    f = Frame(foreign).numbered() if not isinstance(foreign, Frame) else foreign.numbered()
    seq = F.struct(*[F.col(c) for c, _ in f.order])
    document = Scope.of(f.df).root()
    right_key, right_type, right_many = _key(Scope.of(f.df), spec["foreignField"])
    right = f.df.select(right_key.alias("__k"), F.struct(seq.alias("s"), document.alias("d")).alias("__d"))
    if right_many:
        right = right.withColumn("__k", F.explode_outer(_array_keys(F.col("__k"))))
    left = frame
    left_key, left_type, left_many = _key(Scope.of(left.df), spec["localField"])
    if unwound is not None and left_many:
        return None
    numeric = isinstance(left_type, T.NumericType) and isinstance(right_type, T.NumericType)
    fits = numeric or filters.type_name(left_type) == filters.type_name(right_type) or isinstance(left_type, T.NullType) or isinstance(right_type, T.NullType)
    wide = expressions.wider(left_type, right_type) if numeric else left_type if not isinstance(left_type, T.NullType) else right_type

    def cast(c: Column, kind: T.DataType) -> Column:
        c = c if fits else F.struct(F.lit(filters.type_name(kind)).alias("t"), c.cast("string").alias("v"))
        return by.key(c.cast(wide) if numeric or isinstance(kind, T.NullType) else c, wide) if fits else F.when(c["v"].isNotNull(), c)

    right = right.select(cast(F.col("__k"), right_type).alias("__k"), "__d")
    if unwound is not None:
        df = left.df.withColumn("__lk", cast(left_key, left_type)).join(right, F.col("__lk").eqNullSafe(F.col("__k")), "left" if unwound else "inner")
        place = frame.fresh() + "l"
        order = left.order if left.order is not None else ((ORD, True),) if ORD in left.df.columns else None
        df = df.select(*left.df.columns, F.col("__d.s").alias(place), F.col("__d.d").alias("__as"))
        return _placed(Frame(df if order is not None else df.drop(place), order and (*order, (place, True))), spec["as"])
    asked = (left.df.select(F.explode_outer(_array_keys(left_key)).alias("__lk")) if left_many else left.df.select(left_key.alias("__lk"))).select(cast(F.col("__lk"), left_type).alias("__lk"))
    right = right.join(asked, F.col("__k").eqNullSafe(F.col("__lk")), "left_semi").groupBy("__k").agg(F.collect_list("__d").alias("__all"))
    nested = lambda all_: F.coalesce(F.transform(F.array_sort(all_), lambda x: x["d"]), F.array().cast(T.ArrayType(_document_type(f)))).alias("__as")
    if not left_many:
        df = left.df.withColumn("__lk", cast(left_key, left_type)).join(right, F.col("__lk").eqNullSafe(F.col("__k")), "left").select(*left.df.columns, nested(F.col("__all")))
        return _placed(Frame(df, left.order), spec["as"])
    # Arrays: each row's distinct elements are joined and its matches come together again, once each.
    left = left.numbered()
    numbered = left.df.withColumn("__row", F.monotonically_increasing_id())
    keys = numbered.select("__row", F.explode_outer(_array_keys(left_key)).alias("__lk"))
    found = keys.select("__row", cast(F.col("__lk"), left_type).alias("__lk")).join(right, F.col("__lk").eqNullSafe(F.col("__k"))).select("__row", F.explode("__all").alias("__d"))
    lists = found.groupBy("__row").agg(F.array_distinct(F.array_sort(F.collect_list("__d"))).alias("__all"))
    df = numbered.join(lists, "__row", "left").select(*left.df.columns, nested(F.col("__all")))
    return _placed(Frame(df, left.order), spec["as"])


def _key(scope: Scope, path: str) -> tuple[Column, T.DataType, bool]:
    v = resolve(scope, path)
    if v is None:
        return F.lit(None), T.NullType(), False
    many = v.many or isinstance(v.type, T.ArrayType)
    return v.col, (v.type.elementType if many else v.type), many


def _array_keys(c: Column) -> Column:
    return F.when(F.size(F.coalesce(c, F.array())) == 0, F.array(F.lit(None))).otherwise(F.array_distinct(c))


def _document_type(f: Frame) -> T.StructType:
    return T.StructType([x for x in f.df.schema.fields if not x.name.startswith("__")])


def _placed(frame: Frame, path: str) -> Frame:
    name, new = with_path(Scope.of(frame.df), path, lambda _: F.col("__as"))
    return Frame(frame.df.withColumn(name, new).drop("__as"), frame.order)
