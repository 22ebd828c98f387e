"""Updates as pure transformations of a frame: modifiers, replacements, pipelines and upserts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BAD_VALUE, QueryError
from ..functions import expressions, filters
from ..functions.collation import Collation
from ..functions.paths import NULLS, Scope, Value, null_paths, resolve, with_path
from ..sources.catalog import cast_to, merged
from . import pipeline as stages
from . import shaping
from .frame import ORD, Frame

SCALAR = ("$set", "$unset", "$inc", "$mul", "$min", "$max")
ARRAY = ("$push", "$addToSet", "$pop", "$pull", "$pullAll")
PIPELINE = ("$set", "$addFields", "$unset", "$project", "$replaceRoot", "$replaceWith")
_POSITION = re.compile(r"^\$(?:\[([a-z][a-zA-Z0-9]*)?\])?$")


def fail(message: str) -> QueryError:
    return QueryError(BAD_VALUE, message)


def parse(update, array_filters: list | None = None) -> str:
    """``modifiers``, ``replacement`` or ``pipeline``; raises all errors that need no data."""
    if isinstance(update, list):
        if not update:
            raise fail("an update pipeline must not be empty")
        for name, _ in stages.parse(update):
            if name not in PIPELINE:
                raise fail(f"update pipeline stage {name} is not supported")
        return "pipeline"
    if not isinstance(update, dict):
        raise fail("an update must be a document or a pipeline")
    dollars = [k.startswith("$") for k in update]
    if not any(dollars):
        return "replacement"
    if not all(dollars):
        raise fail("an update cannot mix modifiers and fields")
    paths, used = [], set()
    for op, spec in update.items():
        if op not in (*SCALAR, *ARRAY, "$rename", "$setOnInsert"):
            raise fail(f"update operator {op} is not supported")
        if not isinstance(spec, dict) or not spec:
            raise fail(f"{op} requires a non-empty document")
        for path, v in spec.items():
            marks = [p for p in path.split(".") if p.startswith("$")]
            if len(marks) > 1 or any(not _POSITION.match(m) for m in marks):
                raise fail(f"positional path {path} is not supported")
            if marks and op not in SCALAR:
                raise fail(f"{op} does not support positional paths")
            used |= {m[1] for x in marks if (m := _POSITION.match(x)) and m[1]}
            if path == "_id" and op != "$setOnInsert":
                raise fail("_id is immutable")
            if op in ("$inc", "$mul") and not filters.is_number(v):
                raise fail(f"{op} requires a number")
            if op == "$pop" and (isinstance(v, bool) or v not in (1, -1)):
                raise fail("$pop requires 1 or -1")
            if op == "$pullAll" and not isinstance(v, list):
                raise fail("$pullAll requires an array")
            if op in ("$push", "$addToSet") and filters.is_operators(v):
                for k in v:
                    if k != "$each":
                        raise fail(f"{op} option {k} is not supported")
                if not isinstance(v["$each"], list):
                    raise fail(f"{op} $each requires an array")
            if op == "$pull" and isinstance(v, dict):
                filters.parse_operators(v) if filters.is_operators(v) and not any(k in filters.LOGICAL for k in v) else filters.parse(v)
            if op == "$rename":
                if not isinstance(v, str) or not v or v.startswith("$") or v == "_id":
                    raise fail("$rename requires a field path")
                paths.append(v)
            paths.append(path)
    plain = [re.sub(r"\.\$(\[[a-zA-Z0-9]*\])?", "", p) for p in paths]
    for i, p in enumerate(plain):
        for j, q in enumerate(plain):
            if i != j and (p == q or q.startswith(p + ".")):
                raise fail(f"update paths {paths[i]} and {paths[j]} conflict")
    named: set = set()
    for f in array_filters or []:
        names = {k.split(".")[0] for k in f if not k.startswith("$")}
        if not isinstance(f, dict) or len(names) != 1 or names & named:
            raise fail("an array filter must name one identifier, once")
        named |= names
    if named != used:
        raise fail(f"array filters {sorted(named)} do not fit the identifiers {sorted(used)}")
    return "modifiers"


def typed(v, kind: T.DataType | None) -> Column:
    """A literal in a field's type, or a wider one; a frame has one schema."""
    c, own = expressions.literal(v)
    if kind is None or isinstance(kind, T.NullType):
        return c
    if v is None:
        return c.cast(kind)
    if isinstance(kind, T.NumericType) and isinstance(own, T.NumericType):
        return c.cast(expressions.wider(kind, own))
    if filters.type_name(kind) != filters.type_name(own) and not (isinstance(kind, T.StructType) or isinstance(kind, T.ArrayType)):
        raise fail(f"cannot store {v!r} in a field of type {kind.simpleString()}")
    return c.cast(kind)


def _scalar(op: str, c: Column | None, kind: T.DataType | None, v) -> Column | None:
    if op == "$unset":
        return None if kind is None else F.lit(None).cast(kind)
    if op == "$set" or c is None:
        return typed(0 if op == "$mul" and c is None else v, kind)
    if op in ("$inc", "$mul"):
        if not isinstance(kind, T.NumericType):
            raise fail(f"{op} requires a numeric field")
        n = typed(v, kind)
        if isinstance(kind, T.IntegerType):
            c = c.cast("long")  # an int that outgrows its width becomes a long
        return F.coalesce(c, F.lit(0)) + n if op == "$inc" else F.coalesce(c, F.lit(0)) * n
    return (F.least if op == "$min" else F.greatest)(c, typed(v, kind))


def _array(op: str, c: Column | None, kind: T.DataType | None, v, by: Collation) -> Column | None:
    if c is None:
        if op not in ("$push", "$addToSet"):
            return None
        each = v["$each"] if filters.is_operators(v) else [v]
        new = F.array(*[expressions.literal(x)[0] for x in each])
        return new if op == "$push" else F.array_distinct(new)
    if not isinstance(kind, T.ArrayType):
        raise fail(f"{op} requires an array field")
    item = kind.elementType
    if op == "$pop":
        return F.slice(c, F.lit(1) if v == 1 else F.lit(2), F.greatest(F.size(c) - 1, F.lit(0)))
    if op == "$pull":
        test = (lambda e: filters.element_matches(e, item, v, by)) if isinstance(v, dict) else (lambda e: filters.sure(filters.whole(e, item, v, by)))
        return F.filter(c, lambda e: ~test(e))
    if op == "$pullAll":
        return F.filter(c, lambda e: ~reduce(lambda a, b: a | b, [filters.sure(filters.whole(e, item, x, by)) for x in v], F.lit(False)))
    each = [typed(x, item) for x in (v["$each"] if filters.is_operators(v) else [v])]
    have = F.coalesce(c, F.array().cast(kind))
    if op == "$push":
        return F.concat(have, F.array(*each)) if each else have
    new = F.array_distinct(F.array(*each)) if each else F.array().cast(kind)
    return F.concat(have, F.filter(new, lambda x: ~F.exists(have, lambda e: e.eqNullSafe(x))))


def _predicates(query: dict) -> Iterator[tuple[str, object]]:
    """A filter's predicates on fields, those within $and too."""
    for k, v in query.items():
        if k == "$and":
            for q in v:
                yield from _predicates(q)
        else:
            yield k, v


def _positional(path: str, query: dict, array_filters: list, scope: Scope, make, by: Collation) -> tuple[str, Column]:
    """Set the elements of one array that a ``$``, ``$[]`` or ``$[id]`` names."""
    parts = path.split(".")
    at = next(i for i, p in enumerate(parts) if p.startswith("$"))
    prefix, mark, rest = ".".join(parts[:at]), parts[at], ".".join(parts[at + 1 :])
    array = resolve(scope, prefix)
    if array is None or array.many or not isinstance(array.type, T.ArrayType):
        raise fail(f"{path} requires one array")
    item = array.type.elementType

    def changed(e: Column) -> Column:
        if not rest:
            return make(e, item)
        if not isinstance(item, T.StructType):
            raise fail(f"{path} requires an array of documents")
        inner = Scope.inside(e, item)

        def leaf(parent: Scope) -> Column | None:
            name = rest.rsplit(".", 1)[-1]
            return make(parent.get(name), parent.schema[name].dataType) if parent.has(name) else make(None, None)

        name, new = with_path(inner, rest, leaf)
        fields = [(new if f.name == name else e.getField(f.name)).alias(f.name) for f in item.fields]
        return F.when(e.isNotNull(), F.struct(*fields, *([] if inner.has(name) else [new.alias(name)])))

    identifier = _POSITION.match(mark)[1]
    if mark == "$[]":
        out = F.transform(array.col, changed)
    elif identifier:
        spec = next(f for f in array_filters if any(k.split(".")[0] == identifier for k in f))
        own = {k.partition(".")[2]: v for k, v in spec.items()}
        test = (lambda e: filters.element_matches(e, item, own, by)) if "" not in own else (lambda e: filters._field(Value(e, item), own[""] if filters.is_operators(own[""]) else {"$eq": own[""]}, by, scope, ""))
        out = F.transform(array.col, lambda e: F.when(test(e), changed(e)).otherwise(e))
    else:
        own = [(k[len(prefix) + 1 :], v) for k, v in _predicates(query) if k == prefix or k.startswith(prefix + ".")]
        if not own:
            raise fail(f"positional path {path} needs a predicate on {prefix}")

        def hit(e: Column) -> Column:
            tests = []
            for k, v in own:
                if k:
                    tests.append(filters.element_matches(e, item, {k: v}, by))
                elif isinstance(v, dict) and "$elemMatch" in v:
                    tests.append(filters.element_matches(e, item, v["$elemMatch"], by))
                else:
                    tests.append(filters._field(Value(e, item), v if filters.is_operators(v) else {"$eq": v}, by, scope, ""))
            return reduce(lambda a, b: a & b, tests)

        first = F.array_position(F.transform(array.col, hit), True) - 1
        out = F.transform(array.col, lambda e, i: F.when(i == first, changed(e)).otherwise(e))
    return with_path(scope, prefix, lambda _: out)


def _modified(df: DataFrame, query: dict, update: dict, array_filters: list, hit: Column, by: Collation) -> DataFrame:
    def put(df: DataFrame, name: str, new: Column | None) -> DataFrame:
        if new is None:
            return df.drop(name)
        if name not in df.columns:
            return df.withColumn(name, F.when(hit, new))
        old, have = F.col(f"`{name}`"), df.schema[name].dataType
        want = df.select(new.alias("n")).schema["n"].dataType
        if not isinstance(want, T.NullType) and want != have:
            kind = merged(have, want)
            old, new = cast_to(old, have, kind), cast_to(new, want, kind)
        return df.withColumn(name, F.when(hit, new).otherwise(old))

    for op, spec in update.items():
        if op == "$setOnInsert":
            continue
        for path, v in spec.items():
            scope = Scope.of(df)
            if op == "$rename":
                old = resolve(scope, path)
                if old is None:
                    continue
                df = put(df, *with_path(scope, v, lambda parent, c=old.col, n=v: F.coalesce(c, parent.get(n.rsplit(".", 1)[-1])) if parent.has(n.rsplit(".", 1)[-1]) else c))
                df = put(df, *with_path(Scope.of(df), path, lambda _, k=old.type: F.lit(None).cast(k)))
            elif "$" in path:
                df = put(df, *_positional(path, query, array_filters, scope, lambda c, k, op=op, v=v: _scalar(op, c, k, v), by))
            else:
                value = resolve(scope, path)
                c, own = value and value.col, value and value.type
                new = _array(op, c, own, v, by) if op in ARRAY else _scalar(op, c, own, v)
                if new is None and value is None:
                    continue
                df = put(df, *with_path(scope, path, lambda _, n=new: n))
    return _with_nulls(df, update, hit)


def _with_nulls(df: DataFrame, update: dict, hit: Column) -> DataFrame:
    """Paths that are set to null are explicit nulls; other paths that an update writes are none any more."""
    written = [(op, p, v) for op, spec in update.items() if op != "$setOnInsert" for p, v in spec.items() if "$" not in p]
    made = [p for op, p, v in written if op == "$set" and v is None]
    over = [p for op, p, v in written if p not in made] + [v for op, _, v in written if op == "$rename"]
    if not made and NULLS not in df.columns:
        return df
    texts = lambda some: F.array(*map(F.lit, some)).cast("array<string>")
    have = F.col(NULLS) if NULLS in df.columns else F.lit(None).cast("array<string>")
    return df.withColumn(NULLS, F.when(hit, F.array_union(F.array_except(F.coalesce(have, texts([])), texts(over)), texts(made))).otherwise(have))


def flagged(df: DataFrame, query: dict, update, multi: bool = True, array_filters: list | None = None, collation=None, sort: dict | None = None) -> DataFrame:
    """The updated documents with __hit (matched) and __changed (matched and different)."""
    kind = parse(update, array_filters)
    match = filters.matches(query, Scope.of(df), Collation.parse(collation))
    columns = [c for c in df.columns if not c.startswith("__")]
    if multi:
        df = df.withColumn("__hit", match)
    else:
        # The first match in order is one row: its number joins back without a shuffle.
        stored = ORD in df.columns
        df = df if stored else df.withColumn(ORD, F.monotonically_increasing_id())
        frame = Frame(df.where(match)).numbered()
        frame = shaping.sort(frame, sort, Collation.parse(collation)) if sort else frame
        one = frame.df.orderBy(*frame.keys()).limit(1).select(ORD, F.lit(True).alias("__hit"))
        df = df.join(F.broadcast(one), ORD, "left").withColumn("__hit", F.coalesce("__hit", F.lit(False)))
        df = df if stored else df.drop(ORD)
    hit = F.col("__hit")
    df = df.withColumn("__old", F.struct(*[F.col(f"`{c}`") for c in columns], *[c for c in df.columns if c == NULLS]))
    if kind == "modifiers":
        out = _modified(df, query, update, array_filters or [], hit, Collation.parse(collation))
    elif kind == "replacement":
        if "_id" in update and "_id" in columns:
            out = df.withColumn("_id", F.when(hit & ~F.col("_id").eqNullSafe(typed(update["_id"], df.schema["_id"].dataType)), F.raise_error(F.lit("_id is immutable")).cast(df.schema["_id"].dataType)).otherwise(F.col("_id")))
        else:
            out = df
        for c in columns:
            if c != "_id":
                out = out.withColumn(c, F.when(hit, typed(update.get(c), df.schema[c].dataType)).otherwise(F.col(f"`{c}`")))
        for c, v in update.items():
            if c not in columns:
                out = out.withColumn(c, F.when(hit, expressions.literal(v)[0]))
        if (nulls := null_paths(update)) or NULLS in out.columns:
            out = out.withColumn(NULLS, F.when(hit, F.array(*map(F.lit, nulls)).cast("array<string>")).otherwise(F.col(NULLS) if NULLS in out.columns else F.lit(None)))
    else:
        frame = Frame(df)
        for name, spec in stages.parse(update):
            frame = stages._run(frame, name, spec, None, Collation(), False)
        new = frame.df
        names = [*columns, *[c for c in new.columns if c not in columns and not c.startswith("__")]]
        picked = []
        for c in names:
            old = F.col("__old").getField(c) if c in columns else F.lit(None)
            picked.append((old if c == "_id" else F.when(hit, F.col(f"`{c}`")).otherwise(old) if c in new.columns else F.when(~hit, old)).alias(c))
        out = new.select(*picked, "__hit", "__old", *[c for c in new.columns if c in (ORD, NULLS)])
    names = [c for c in out.columns if not c.startswith("__")]
    before = df.schema["__old"].dataType
    old = F.struct(*[cast_to(F.col("__old").getField(c), before[c].dataType, out.schema[c].dataType).alias(c) if c in columns else F.lit(None).cast(out.schema[c].dataType).alias(c) for c in names])
    # Nulls within documents of another shape aren't changes.
    changed = ~old.eqNullSafe(F.struct(*[F.col(f"`{c}`") for c in names]))
    if NULLS in out.columns:
        none = F.array().cast("array<string>")
        was = F.coalesce(F.col("__old").getField(NULLS), none) if NULLS in before.fieldNames() else none
        changed = changed | ~F.array_sort(was).eqNullSafe(F.array_sort(F.coalesce(NULLS, none)))
    return out.withColumn("__changed", hit & changed)


def base_document(query: dict) -> dict:
    """What an upsert takes from its filter: the equality predicates, nested by path."""
    out: dict = {}
    for k, v in query.items():
        if k == "$and":
            for q in v:
                out.update(base_document(q))
        elif not k.startswith("$"):
            if filters.is_operators(v):
                if "$eq" not in v:
                    continue
                v = v["$eq"]
            at = out
            *parents, name = k.split(".")
            for p in parents:
                at = at.setdefault(p, {})
            at[name] = v
    return out


def update(df: DataFrame, query: dict, change, multi: bool = True, upsert: bool = False, array_filters: list | None = None, collation=None) -> DataFrame:
    """The documents after an update."""
    out = flagged(df, query, change, multi, array_filters, collation)
    out = out.drop("__hit", "__changed", "__old")
    if upsert and df.where(filters.matches(query, Scope.of(df), Collation.parse(collation))).isEmpty():
        out = out.unionByName(upserted(df, query, change), allowMissingColumns=True)
    return out


def upserted(df: DataFrame, query: dict, change) -> DataFrame:
    """The one document that an upsert adds."""
    base = base_document(query)
    row = df.sparkSession.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields])
    sets: dict = {k: v for k, v in base.items()}
    kind = parse(change)
    if kind == "replacement":
        sets = {**{k: v for k, v in base.items() if k == "_id"}, **change}
    for k, v in sets.items():
        c = typed(v, df.schema[k].dataType if k in df.columns else None)
        row = row.withColumn(k, c)
    if kind == "pipeline":
        frame = Frame(row)
        for name, spec in stages.parse(change):
            frame = stages._run(frame, name, spec, None, Collation(), False)
        return frame.df
    if kind == "modifiers":
        merged = {**{k: v for k, v in change.items() if k != "$setOnInsert"}}
        if "$setOnInsert" in change:
            merged["$set"] = {**merged.get("$set", {}), **change["$setOnInsert"]}
        row = _modified(row, query, merged, [], F.lit(True), Collation())
    return row


def delete(df: DataFrame, query: dict, limit: int = 0, collation=None) -> DataFrame:
    """The documents that a delete leaves; a limit of 1 takes the first match in scan order."""
    if isinstance(limit, bool) or limit not in (0, 1):
        raise fail("delete limit must be 0 or 1")
    match = filters.matches(query, Scope.of(df), Collation.parse(collation))
    if not limit:
        return df.where(~match)
    numbered = df if ORD in df.columns else df.withColumn(ORD, F.monotonically_increasing_id())
    one = numbered.where(match).orderBy(ORD).limit(1).select(ORD)
    return numbered.join(F.broadcast(one), ORD, "left_anti").select(*df.columns)
