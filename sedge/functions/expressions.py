"""Aggregation expressions as columns, with constants checked before any data is read."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BAD_VALUE, FAILED_TO_PARSE, QueryError
from .collation import Collation
from .filters import is_number, type_name
from .paths import Scope, resolve

NUMBERS = {"$add", "$multiply", "$subtract", "$divide"}
STRINGS = {"$concat", "$toLower", "$toUpper"}
COMPARE = {"$eq": "==", "$ne": "!=", "$gt": ">", "$gte": ">=", "$lt": "<", "$lte": "<="}
ARITY = {"$subtract": 2, "$divide": 2, **dict.fromkeys(COMPARE, 2)}
#: The cross-type order of values: lower ranks sort first.
RANK = {"null": 0, "int": 1, "long": 1, "double": 1, "string": 2, "object": 3, "array": 4, "objectId": 5, "bool": 6, "date": 7, "binData": 8}
KNOWN = {*NUMBERS, *STRINGS, *COMPARE, "$literal", "$ifNull", "$toString", "$and", "$or", "$not", "$cond"}


def operator_of(e) -> str | None:
    if isinstance(e, dict) and any(str(k).startswith("$") for k in e):
        if len(e) != 1:
            raise QueryError(FAILED_TO_PARSE, f"an expression document takes one operator: {list(e)}")
        return next(iter(e))
    return None


def _args(op: str, x) -> list:
    args = x if isinstance(x, list) else [x]
    if op in ARITY and len(args) != ARITY[op]:
        raise QueryError(BAD_VALUE, f"{op} requires {ARITY[op]} arguments")
    if op in ("$toString", "$toLower", "$toUpper", "$not") and len(args) != 1:
        raise QueryError(BAD_VALUE, f"{op} requires one argument")
    if op == "$ifNull" and len(args) < 2:
        raise QueryError(BAD_VALUE, "$ifNull requires at least two arguments")
    return args


def _branches(x) -> list:
    if isinstance(x, list) and len(x) == 3:
        return x
    if isinstance(x, dict) and set(x) == {"if", "then", "else"}:
        return [x["if"], x["then"], x["else"]]
    raise QueryError(BAD_VALUE, "$cond requires if, then and else")


def check(e) -> None:
    """Everything that can be wrong with an expression without data, constants folded."""
    if isinstance(e, str) and e.startswith("$"):
        if e.startswith("$$"):
            if e.split(".")[0] not in ("$$ROOT", "$$CURRENT"):
                raise QueryError(BAD_VALUE, f"unsupported variable {e.split('.')[0]}")
        elif not all(e[1:].split(".")):
            raise QueryError(BAD_VALUE, f"invalid field path {e!r}")
    elif isinstance(e, list):
        for x in e:
            check(x)
    elif isinstance(e, dict):
        op = operator_of(e)
        if op is None:
            for k, x in e.items():
                if "." in k or not k:
                    raise QueryError(BAD_VALUE, f"invalid field name {k!r} in an expression document")
                check(x)
            return
        if op not in KNOWN:
            raise QueryError(BAD_VALUE, f"unsupported aggregation expression {op}")
        if op == "$literal":
            return
        args = _branches(e[op]) if op == "$cond" else _args(op, e[op])
        for x in args:
            check(x)
        known = [(constant(x), x) for x in args if is_constant(x)]
        if op in NUMBERS and (wrong := [x for v, x in known if v is not None and not is_number(v)]):
            raise QueryError(BAD_VALUE, f"{op} requires numeric arguments, not {wrong[0]!r}")
        if op in STRINGS and (wrong := [x for v, x in known if v is not None and not isinstance(v, str)]):
            raise QueryError(BAD_VALUE, f"{op} requires string arguments, not {wrong[0]!r}")
        if op == "$divide" and is_constant(args[1]) and constant(args[1]) == 0:
            raise QueryError(BAD_VALUE, "$divide by zero")


def is_constant(e) -> bool:
    if isinstance(e, str):
        return not e.startswith("$")
    if isinstance(e, list):
        return all(map(is_constant, e))
    if isinstance(e, dict):
        return "$literal" in e or all(is_constant(x) for x in e.values())
    return True


def constant(e):
    """The value of a constant expression; arithmetic only, other operators stay as they are."""
    op = operator_of(e)
    if op == "$literal":
        return e[op]
    if op in NUMBERS:
        v = [constant(x) for x in _args(op, e[op])]
        if any(not is_number(x) for x in v):
            return None
        if op == "$divide":
            return v[0] / v[1] if v[1] else None
        return v[0] - v[1] if op == "$subtract" else reduce((lambda a, b: a + b) if op == "$add" else (lambda a, b: a * b), v)
    if op in STRINGS:
        return "x"
    return None if op else e


def compile(e, scope: Scope, by: Collation | None = None) -> tuple[Column, T.DataType]:
    """(column, type) of a checked expression; a missing field is a null of no type."""
    by = by or Collation()
    if isinstance(e, str) and e.startswith("$"):
        if e.startswith("$$"):
            _, _, rest = e.partition(".")
            if not rest:
                return scope.root(), T.StructType([f for f in scope.schema.fields if not f.name.startswith("__")])
            e = f"${rest}"
        v = resolve(scope, e[1:])
        return (F.lit(None), T.NullType()) if v is None else (v.col, v.type)
    if isinstance(e, list):
        parts = [compile(x, scope, by) for x in e]
        return F.array(*[c for c, _ in parts]), T.ArrayType(next((k for _, k in parts if not isinstance(k, T.NullType)), T.NullType()))
    if isinstance(e, dict):
        op = operator_of(e)
        if op is None:
            parts = {k: compile(x, scope, by) for k, x in e.items()}
            return F.struct(*[c.alias(k) for k, (c, _) in parts.items()]), T.StructType([T.StructField(k, t) for k, (_, t) in parts.items()])
        return _operator(op, e[op], scope, by)
    return literal(e)


def literal(v) -> tuple[Column, T.DataType]:
    if isinstance(v, dict):
        parts = {k: literal(x) for k, x in v.items()}
        return F.struct(*[c.alias(k) for k, (c, _) in parts.items()]), T.StructType([T.StructField(k, t) for k, (_, t) in parts.items()])
    if isinstance(v, list):
        parts = [literal(x) for x in v]
        return F.array(*[c for c, _ in parts]), T.ArrayType(parts[0][1] if parts else T.NullType())
    if isinstance(v, bool):
        return F.lit(v), T.BooleanType()
    if isinstance(v, int):
        return F.lit(v), T.IntegerType() if -(2**31) <= v < 2**31 else T.LongType()
    if isinstance(v, dt.datetime):
        return F.lit(v).cast("timestamp_ntz"), T.TimestampNTZType()
    return F.lit(v), T.StringType() if isinstance(v, str) else T.DoubleType() if isinstance(v, float) else T.NullType()


def truth(c: Column, kind: T.DataType) -> Column:
    """Truth of a value: null, false and zero are false, all else is true."""
    if isinstance(kind, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    return F.coalesce(c != 0, F.lit(False)) if isinstance(kind, T.NumericType) else c.isNotNull()


def wider(a: T.DataType, b: T.DataType) -> T.DataType:
    order = (T.NullType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
    at = lambda k: next((i for i, c in enumerate(order) if type(k) is c), len(order))
    return a if at(a) >= at(b) else b


def compared(op: str, a: tuple[Column, T.DataType], b: tuple[Column, T.DataType], by: Collation) -> Column:
    """Comparison in the cross-type order; null and missing are one value, below all others."""
    (x, s), (y, t) = a, b
    ranks = [RANK[type_name(k)] for k in (s, t)]
    if ranks[0] == ranks[1] and ranks[0]:
        x, y = by.key(x, s), by.key(y, t)
        none = F.when(x.isNull() & y.isNull(), 0).when(x.isNull(), -1).when(y.isNull(), 1)
        sign = none.otherwise(F.when(x < y, -1).when(x > y, 1).otherwise(0)) if op not in ("==", "!=") else F.when(x.eqNullSafe(y), 0).otherwise(1)
    else:
        r = [F.when(c.isNull(), 0).otherwise(k) if k else F.lit(0) for c, k in ((x, ranks[0]), (y, ranks[1]))]
        sign = F.when(r[0] < r[1], -1).when(r[0] > r[1], 1).otherwise(0)
    return {"==": sign == 0, "!=": sign != 0, ">": sign > 0, ">=": sign >= 0, "<": sign < 0, "<=": sign <= 0}[op]


def _operator(op: str, x, scope: Scope, by: Collation) -> tuple[Column, T.DataType]:
    if op == "$literal":
        return literal(x)
    args = [compile(a, scope, by) for a in (_branches(x) if op == "$cond" else _args(op, x))]
    cols, kinds = [c for c, _ in args], [k for _, k in args]
    if op == "$cond":
        return F.when(truth(*args[0]), cols[1]).otherwise(cols[2]), kinds[1] if not isinstance(kinds[1], T.NullType) else kinds[2]
    if op == "$ifNull":
        return F.coalesce(*cols), next((k for k in kinds if not isinstance(k, T.NullType)), T.NullType())
    if op in COMPARE:
        return compared(COMPARE[op], *args, by), T.BooleanType()
    if op in ("$and", "$or"):
        each = [truth(*a) for a in args]
        return (reduce((lambda a, b: a & b) if op == "$and" else (lambda a, b: a | b), each) if each else F.lit(op == "$and")), T.BooleanType()
    if op == "$not":
        return ~truth(*args[0]), T.BooleanType()
    if op == "$toString":
        if isinstance(kinds[0], (T.ArrayType, T.StructType)):
            raise QueryError(BAD_VALUE, "$toString requires a scalar")
        return cols[0].cast("string"), T.StringType()
    if op in STRINGS:
        if any(not isinstance(k, (T.StringType, T.NullType)) for k in kinds):
            raise QueryError(BAD_VALUE, f"{op} requires string arguments")
        if op == "$concat":
            return F.concat(*cols), T.StringType()
        # A missing string is an empty one here.
        return (F.lower if op == "$toLower" else F.upper)(F.coalesce(cols[0].cast("string"), F.lit(""))), T.StringType()
    if any(not isinstance(k, (T.NumericType, T.NullType)) for k in kinds):
        raise QueryError(BAD_VALUE, f"{op} requires numeric arguments")
    kind = reduce(wider, kinds)
    if op == "$divide":
        zero = F.raise_error(F.lit("$divide by zero")).cast("double")
        return F.when(cols[1] == 0, zero).otherwise(cols[0].cast("double") / cols[1]), T.DoubleType()
    if op == "$subtract":
        return cols[0] - cols[1], kind
    return reduce((lambda a, b: a + b) if op == "$add" else (lambda a, b: a * b), cols), kind
