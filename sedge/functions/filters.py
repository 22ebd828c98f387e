"""Filter documents as boolean columns: one matcher for every command.

Predicates are two-valued: a missing field (a null cell) makes a predicate false and its
negation true. Operands of another type than the field match nothing, decided while
compiling, so that Catalyst sees plain comparisons that reach the Parquet scan.
"""

from __future__ import annotations

import datetime as dt
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BAD_VALUE, INVALID_OPTIONS, QueryError
from .collation import Collation
from .paths import NULLS, explicit_null, Scope, Value, check_path, resolve

#: Type aliases and their numeric codes.
TYPES = {"double": 1, "string": 2, "object": 3, "array": 4, "objectId": 7, "bool": 8, "date": 9, "null": 10, "int": 16, "long": 18}
_CODES = {v: k for k, v in TYPES.items()}
BOUNDS = {"$gt": "__gt__", "$gte": "__ge__", "$lt": "__lt__", "$lte": "__le__"}
LOGICAL = ("$and", "$or", "$nor")


def sure(p: Column) -> Column:
    return F.coalesce(p, F.lit(False))


def bad(message: str) -> QueryError:
    return QueryError(BAD_VALUE, message)


def is_number(v) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def type_name(kind: T.DataType, metadata: dict | None = None) -> str:
    if (metadata or {}).get("bsonType") == "objectId":
        return "objectId"
    for cls, name in ((T.StringType, "string"), (T.BooleanType, "bool"), (T.LongType, "long"), (T.IntegralType, "int"), (T.FractionalType, "double"), (T.ArrayType, "array"), (T.StructType, "object"), (T.MapType, "object"), (T.NullType, "null")):
        if isinstance(kind, cls):
            return name
    return "date" if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else "binData"


def comparable(kind: T.DataType, v) -> bool:
    name = type_name(kind)
    if isinstance(v, bool):
        return name == "bool"
    if is_number(v):
        return name in ("int", "long", "double")
    if isinstance(v, str):
        return name in ("string", "objectId")
    return isinstance(v, (dt.datetime, dt.date)) and name == "date"


def literal(v, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampNTZType):
        return F.lit(v if isinstance(v, dt.datetime) else dt.datetime(v.year, v.month, v.day)).cast("timestamp_ntz")
    return F.lit(v)


def whole(c: Column, kind: T.DataType, v, by: Collation) -> Column:
    """Equality of whole values: documents and arrays member by member."""
    if v is None:
        return c.isNull()
    if isinstance(v, dict):
        if not isinstance(kind, T.StructType) or any(k not in kind.fieldNames() for k in v):
            return F.lit(False)
        return c.isNotNull() & reduce(lambda a, b: a & b, [sure(whole(c.getField(f.name), f.dataType, v.get(f.name), by)) for f in kind.fields], F.lit(True))
    if isinstance(v, (list, tuple)):
        if not isinstance(kind, T.ArrayType):
            return F.lit(False)
        return (F.size(c) == len(v)) & reduce(lambda a, b: a & b, [sure(whole(F.get(c, F.lit(i)), kind.elementType, x, by)) for i, x in enumerate(v)], F.lit(True))
    if not comparable(kind, v):
        return F.lit(False)
    return by.key(c, kind) == by.key(literal(v, kind), kind)


def any_of(value: Value, test, two_valued: bool = True) -> Column:
    """``test(column, type)`` of the value itself, of an array's elements, and of all that a path met."""

    def one(c: Column, kind: T.DataType) -> Column:
        if not two_valued and not isinstance(kind, T.ArrayType):
            return test(c, kind)
        p = sure(test(c, kind))
        if isinstance(kind, T.ArrayType):
            p = p | sure(F.exists(c, lambda x: sure(test(x, kind.elementType))))
        return p

    if value.many:
        return sure(F.exists(value.col, lambda x: one(x, value.type.elementType)))
    return one(value.col, value.type)


def java_regex(pattern, options: str = "") -> str:
    if isinstance(pattern, re.Pattern):
        options = "".join(o for o, f in (("i", re.I), ("m", re.M), ("s", re.S)) if pattern.flags & f)
        pattern = pattern.pattern
    if not isinstance(pattern, str):
        raise bad("$regex requires a string pattern")
    if not isinstance(options, str):
        raise bad("$options requires a string")
    for o in options:
        if o not in "ims":
            raise bad(f"$regex option {o} is not supported")
    try:
        re.compile(pattern)
    except re.error as e:
        raise bad(f"invalid $regex pattern: {e}") from e
    if re.search(r"\(\?(?:=|!|<=|<!)", pattern) or re.search(r"(?<!\\)(?:\\\\)*\\[1-9]", pattern):
        raise bad("invalid $regex pattern: look-around and back-references are not supported")
    if "m" not in options:
        # Java's $ also matches before a last line end.
        out, inside, i = [], False, 0
        while i < len(pattern):
            ch = pattern[i]
            if ch == "\\":
                out.append(pattern[i : i + 2])
                i += 2
                continue
            inside = (inside or ch == "[") and ch != "]"
            out.append(r"\z" if ch == "$" and not inside else ch)
            i += 1
        pattern = "".join(out)
    return f"(?d{''.join(sorted(set(options)))}){pattern}"


def _types(operand) -> list[str]:
    given = operand if isinstance(operand, list) else [operand]
    if not given:
        raise bad("$type requires at least one type")
    out: list[str] = []
    for t in given:
        if isinstance(t, bool) or not isinstance(t, (str, int, float)):
            raise bad("$type requires a type name or code")
        if t == "number":
            out += ["int", "long", "double"]
        elif isinstance(t, str) and t in TYPES:
            out.append(t)
        elif not isinstance(t, str) and t in _CODES:
            out.append(_CODES[t])
        else:
            raise bad(f"$type {t} is not supported")
    return out


def is_operators(spec) -> bool:
    return isinstance(spec, dict) and any(str(k).startswith("$") for k in spec)


def parse(query, top: bool = True) -> None:
    """All that can be wrong with a filter without data."""
    if not isinstance(query, dict):
        raise bad("filter must be a document")
    for k, v in query.items():
        if k in LOGICAL:
            if not isinstance(v, list) or not v or not all(isinstance(x, dict) for x in v):
                raise bad(f"{k} requires a non-empty array of documents")
            for x in v:
                parse(x)
        elif str(k).startswith("$"):
            raise bad(f"unsupported top-level query operator {k}")
        elif is_operators(v):
            parse_operators(v)


def parse_operators(spec: dict) -> None:
    for op, x in spec.items():
        if not op.startswith("$"):
            raise bad(f"cannot mix operators and fields: {op}")
        if op in ("$eq", "$ne", *BOUNDS):
            continue
        if op in ("$in", "$nin"):
            if not isinstance(x, list):
                raise bad(f"{op} requires an array")
        elif op == "$exists":
            if not isinstance(x, bool):
                raise bad("$exists requires a boolean")
        elif op == "$not":
            if isinstance(x, re.Pattern):
                java_regex(x)
            elif not isinstance(x, dict) or not x or not is_operators(x):
                raise bad("$not requires an operator document")
            else:
                parse_operators(x)
        elif op == "$regex":
            java_regex(x, spec.get("$options", ""))
        elif op == "$options":
            if "$regex" not in spec:
                raise bad("$options requires $regex")
        elif op == "$type":
            _types(x)
        elif op == "$size":
            if isinstance(x, bool) or not isinstance(x, int) or x < 0:
                raise bad("$size requires a non-negative integer")
        elif op == "$all":
            if not isinstance(x, list):
                raise bad("$all requires an array")
            clauses = [isinstance(e, dict) and "$elemMatch" in e for e in x]
            if any(clauses) and not all(clauses):
                raise bad("$all cannot mix $elemMatch and values")
            for e in x:
                if is_operators(e):
                    if list(e) != ["$elemMatch"]:
                        raise bad("$all supports only $elemMatch operators")
                    parse_operators(e)
        elif op == "$elemMatch":
            if not isinstance(x, dict) or not x:
                raise bad("$elemMatch requires a non-empty document")
            if is_operators(x) and not any(k in LOGICAL for k in x):
                parse_operators(x)
            else:
                parse(x)
        else:
            raise bad(f"unsupported query operator {op}")


def matches(query: dict, scope: Scope, by: Collation | None = None, two_valued: bool = True) -> Column:
    """A filter document as a boolean column, never null unless ``two_valued`` is off.

    Off suits ``where``, which drops nulls: what isn't negated stays a bare comparison and reaches the scan.
    """
    parse(query)
    return _document(query, scope, by or Collation(), two_valued)


def _document(query: dict, scope: Scope, by: Collation, tv: bool = True) -> Column:
    tests = []
    for k, v in query.items():
        if k in LOGICAL:
            each = [_document(x, scope, by, tv or k == "$nor") for x in v]
            joined = reduce((lambda a, b: a & b) if k == "$and" else (lambda a, b: a | b), each)
            tests.append(~joined if k == "$nor" else joined)
        else:
            check_path(k)
            spec = v if is_operators(v) else {"$regex": v} if isinstance(v, re.Pattern) else {"$eq": v}
            tests.append(_field(resolve(scope, k), spec, by, scope, k, tv))
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


def _field(value: Value | None, spec: dict, by: Collation, scope: Scope, path: str, tv: bool = True) -> Column:
    tests = []
    for op, x in spec.items():
        if op == "$options":
            continue
        if op == "$not":
            inner = {"$regex": x} if isinstance(x, re.Pattern) else x
            tests.append(~_field(value, inner, by, scope, path))
        elif op in ("$ne", "$nin"):
            tests.append(~_test(value, "$eq" if op == "$ne" else "$in", x, spec, by, scope, path))
        else:
            tests.append(_test(value, op, x, spec, by, scope, path, tv))
    return reduce(lambda a, b: a & b, tests)


def _missing(value: Value | None) -> Column:
    if value is None:
        return F.lit(True)
    if value.many:
        return value.col.isNull() | sure(F.exists(value.col, lambda x: x.isNull()))
    return value.col.isNull()


def _equal(value: Value | None, x, by: Collation, tv: bool = True) -> Column:
    if isinstance(x, re.Pattern):
        return _regex(value, java_regex(x), tv)
    if x is None:
        nulls = F.lit(False) if value is None or not isinstance(value.type, T.ArrayType) or value.many else sure(F.exists(value.col, lambda e: e.isNull()))
        return sure(_missing(value)) | nulls
    return F.lit(False) if value is None else any_of(value, lambda c, kind: whole(c, kind, x, by), tv)


def _regex(value: Value | None, pattern: str, tv: bool = True) -> Column:
    return F.lit(False) if value is None else any_of(value, lambda c, kind: c.rlike(pattern) if isinstance(kind, T.StringType) else F.lit(False), tv)


def _plain(value: Value | None) -> bool:
    return value is not None and not value.many and not isinstance(value.type, (T.ArrayType, T.StructType))


def _test(value: Value | None, op: str, x, spec: dict, by: Collation, scope: Scope, path: str, tv: bool = True) -> Column:
    if op == "$eq":
        return _equal(value, x, by, tv)
    if op == "$in":
        scalars = [v for v in x if _plain(value) and comparable(value.type, v)]
        if scalars and not by.folds and not any(isinstance(v, re.Pattern) for v in x):
            found = value.col.isin([literal(v, value.type) for v in scalars] if isinstance(value.type, T.TimestampNTZType) else scalars)
            found = sure(found) if tv else found
            return found | _equal(value, None, by) if None in x else found
        return reduce(lambda a, b: a | b, [_equal(value, v, by) for v in x], F.lit(False))
    if op == "$exists":
        present = F.lit(False) if value is None else value.col.isNotNull() & (sure(F.exists(value.col, lambda e: e.isNotNull())) if value.many else F.lit(True))
        if scope.has(NULLS):
            present = present | explicit_null(scope, path)
        return present if x else ~present
    if op in BOUNDS:
        if by.folds and isinstance(x, str):
            raise QueryError(INVALID_OPTIONS, "string range filters are not supported with this collation")
        if value is None or x is None:
            return F.lit(False) if x is not None or op in ("$gt", "$lt") else _equal(value, None, by)
        return any_of(value, lambda c, kind: getattr(c, BOUNDS[op])(literal(x, kind)) if comparable(kind, x) else F.lit(False), tv)
    if op == "$regex":
        return _regex(value, java_regex(x, spec.get("$options", "")), tv)
    if op == "$type":
        wanted = _types(x)
        metadata = scope.schema[path].metadata if scope.has(path) else {}
        return F.lit(False) if value is None else any_of(value, lambda c, kind: c.isNotNull() if type_name(kind, metadata) in wanted else F.lit(False))
    if op == "$size":
        if value is None or value.many or not isinstance(value.type, T.ArrayType):
            return F.lit(False)
        return sure(value.col.isNotNull() & (F.size(value.col) == x))
    if op == "$all":
        each = [_elem(value, e["$elemMatch"], by) if is_operators(e) else _equal(value, e, by) for e in x]
        return reduce(lambda a, b: a & b, each) if each else F.lit(False)
    return _elem(value, x, by)


def _elem(value: Value | None, spec: dict, by: Collation) -> Column:
    if value is None:
        return F.lit(False)
    arrays = value.type.elementType if value.many else value.type
    if not isinstance(arrays, T.ArrayType):
        return F.lit(False)
    test = lambda e: element_matches(e, arrays.elementType, spec, by)
    one = lambda c: sure(F.exists(c, test))
    return sure(F.exists(value.col, one)) if value.many else one(value.col)


def element_matches(e: Column, kind: T.DataType, spec: dict, by: Collation) -> Column:
    """One array element against operators, or against a filter document."""
    if is_operators(spec) and not any(k in LOGICAL for k in spec):
        return _field(Value(e, kind), spec, by, Scope.inside(e, T.StructType()), "")
    if not isinstance(kind, T.StructType):
        return F.lit(False)
    return e.isNotNull() & _document(spec, Scope.inside(e, kind), by)
