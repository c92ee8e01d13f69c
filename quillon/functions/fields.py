"""Tests on dynamically typed metadata as columns over VARIANT.

A value is absent (SQL NULL), null (variant null), or has one of the classes boolean, number, string,
array, object. Nothing is ever coerced: each comparison is gated by the class of the value, and every
leaf is two-valued, so negation is plain NOT and holds for absent values.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import ir
from .yamlcore import to_json

RESERVED = "_$.#@"
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
DATETIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?(?:|[Zz]|[+-][0-9]{2}(?::?[0-9]{2})?)\z"
_RANK = {"boolean": 1, "number": 2, "string": 3, "array": 4, "object": 5}


def at(fm: Column, path: tuple[str, ...]) -> Column:
    """The value at a path; absent where a part is reserved or an inner value is no mapping."""
    if any(part[:1] and part[0] in RESERVED for part in path):
        return F.lit(None).cast("variant")
    quoted = "".join(f'["{p}"]' if "'" in p else f"['{p}']" for p in path)
    return F.variant_get(fm, "$" + quoted, "variant")


def class_of(v: Column) -> Column:
    """null, boolean, number, string, array or object; SQL NULL for an absent value."""
    s = F.schema_of_variant(v)
    return (
        F.when(s == "VOID", "null")
        .when(s == "STRING", "string")
        .when(s == "BOOLEAN", "boolean")
        .when(s.isin("BIGINT", "DOUBLE", "FLOAT", "TINYINT", "SMALLINT", "INT") | s.startswith("DECIMAL"), "number")
        .when(s.startswith("ARRAY"), "array")
        .when(s.startswith("OBJECT<`$float`") | s.startswith("OBJECT<$float"), "number")
        .when(s.startswith("OBJECT"), "object")
    )


def _as(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def _false(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def _is(v: Column, kind: str) -> Column:
    return _false(class_of(v) == kind)


_OPS = {"eq": lambda a, b: a == b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}


def _scalar(v: Column, op: str, literal: Any) -> Column:
    """One comparison of a single value with a scalar literal."""
    compare = _OPS[op]
    if literal is None:
        return _is(v, "null") if op == "eq" else F.lit(False)
    if isinstance(literal, bool):
        return _is(v, "boolean") & _false(compare(_as(v, "boolean"), F.lit(literal)))
    if isinstance(literal, str):
        return _is(v, "string") & _false(compare(_as(v, "string"), F.lit(literal)))
    if isinstance(literal, float) and math.isnan(literal):
        return F.lit(False)
    near = _as(v, "double")
    test = ~F.isnan(near) & compare(near, F.lit(float(literal)))
    if isinstance(literal, int):
        if -(2**63) <= literal < 2**63:
            test = F.when(F.schema_of_variant(v) == "BIGINT", compare(_as(v, "bigint"), F.lit(literal).cast("bigint"))).otherwise(test)
        else:
            whole = _as(v, "decimal(38,0)")
            test = F.when(F.schema_of_variant(v).rlike(r"^(BIGINT|DECIMAL\(\d+,0\))$"), compare(whole, F.lit(str(literal)).cast("decimal(38,0)"))).otherwise(test)
    return _is(v, "number") & _false(test)


def _deep_equal(v: Column, literal: Any) -> Column:
    """Whole values by their parts, so numbers compare as numbers; the order of an object's keys doesn't count."""
    if isinstance(literal, (list, tuple)):
        parts = [_element_equal(F.get(_elements(v), F.lit(i)), x) for i, x in enumerate(literal)]
        size, kind = F.size(_elements(v)), "array"
    else:
        fields = F.try_variant_get(v, "$", "map<string,variant>")
        parts = [_element_equal(F.try_element_at(fields, F.lit(k)), x) for k, x in literal.items()]
        size, kind = F.size(fields), "object"
    return _is(v, kind) & _false(reduce(lambda a, b: a & b, map(_false, parts), size == len(literal)))


def _elements(v: Column) -> Column:
    return _as(v, "array<variant>")


def compare(v: Column, op: str, literal: Any) -> Column:
    """A scalar literal also matches an array with such an element; other literals match whole values."""
    if isinstance(literal, (list, tuple, dict)):
        return _deep_equal(v, literal) if op == "eq" else F.lit(False)
    return _scalar(v, op, literal) | (_is(v, "array") & _false(F.exists(_elements(v), lambda e: _scalar(e, op, literal))))


def _element_equal(e: Column, literal: Any) -> Column:
    return _deep_equal(e, literal) if isinstance(literal, (list, tuple, dict)) else _scalar(e, "eq", literal)


def _has_element(v: Column, literal: Any) -> Column:
    return _false(F.exists(_elements(v), lambda e: _element_equal(e, literal)))


def count_test(n: Column, test: ir.CountTest) -> Column:
    parts = [(n != m) if op == "ne" else _OPS[op](n, F.lit(m)) for op, m in test.comparisons]
    return reduce(lambda a, b: a & b, parts)


def field_test(fm: Column, test: ir.FieldTest) -> Column:
    """The boolean column of one field test; never null."""
    v = at(fm, test.path)
    op, arg = test.op, test.arg
    if op == "ne":
        return ~compare(v, "eq", arg)
    if op in _OPS:
        return compare(v, op, arg)
    if op in ("in", "nin"):
        same = {type(a) for a in arg}
        if len(arg) > 1 and same == {str}:  # one hash lookup instead of a chain of comparisons
            hit = (_is(v, "string") & _false(_as(v, "string").isin(*arg))) | (_is(v, "array") & _false(F.exists(_elements(v), lambda e: _is(e, "string") & _false(_as(e, "string").isin(*arg)))))
        else:
            hit = reduce(lambda a, b: a | b, [compare(v, "eq", a) for a in arg])
        return hit if op == "in" else ~hit
    if op == "exists":
        return v.isNotNull() if arg else v.isNull()
    if op == "type":
        return reduce(lambda a, b: a | b, [_type(v, name) for name in arg])
    if op == "all":
        return _is(v, "array") & reduce(lambda a, b: a & b, [_has_element(v, a) for a in arg])
    if op == "size":
        return _is(v, "array") & _false(count_test(F.size(_elements(v)), arg))
    if op == "not":
        return ~reduce(lambda a, b: a & b, [field_test(fm, t) for t in arg])
    raise ValueError(op)


def _class_of_literal(value: Any) -> str:
    return "boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "string" if isinstance(value, str) else "other"


def typed_test(column: Column, kind: str, test: ir.FieldTest) -> Column | None:
    """The test on a field that is kept in a column of one class, null where absent; None if only the variant will do.

    Each comparison is guarded by IS NOT NULL instead of a coalesce: that is two-valued as well, and Catalyst
    can push it, or its negation, into the scan.
    """

    def compared(op: str, literal: Any) -> Column:
        if isinstance(literal, float) and not math.isfinite(literal):
            return F.lit(False)
        return column.isNotNull() & _OPS[op](column, F.lit(literal)) if _class_of_literal(literal) == kind else F.lit(False)

    op, arg = test.op, test.arg
    if op in ("in", "nin"):
        same = [a for a in arg if _class_of_literal(a) == kind]
        hit = column.isNotNull() & column.isin(*same) if same else F.lit(False)
        return hit if op == "in" else ~hit
    if op == "exists":
        return column.isNotNull() if arg else column.isNull()
    if op == "ne":
        return ~compared("eq", arg)
    if op in _OPS:
        return compared(op, arg)
    if op == "type" and not {"date", "datetime"} & set(arg):
        return column.isNotNull() if kind in arg else F.lit(False)
    if op == "not":
        parts = [typed_test(column, kind, t) for t in arg]
        return None if any(p is None for p in parts) else ~reduce(lambda a, b: a & b, parts)
    return None


def _type(v: Column, name: str) -> Column:
    if name in ("date", "datetime"):
        return _is(v, "string") & _false(_as(v, "string").rlike(DATE if name == "date" else DATETIME))
    return _is(v, name)


def sort_columns(fm: Column, sort: ir.Sort) -> list[Column]:
    """Nulls and absent values first, then by class, then by value; all reversed when descending."""
    v = at(fm, sort.path)
    kind = class_of(v)
    rank = F.coalesce(reduce(lambda w, k: w.when(kind == k, _RANK[k]), list(_RANK)[1:], F.when(kind == "boolean", 1)), F.lit(0))
    keys = [rank, F.when(kind == "number", _as(v, "double")), F.when(kind == "number", _as(v, "bigint")), F.when(kind == "string", _as(v, "string")), F.when(kind == "boolean", _as(v, "boolean").cast("int"))]
    return [k.desc_nulls_last() if sort.descending else k.asc_nulls_first() for k in keys]


def without_reserved(fm: Column) -> Column:
    """The mapping without top-level fields that the engine reserves."""
    fields = F.try_variant_get(fm, "$", "map<string,variant>")
    return F.to_variant_object(F.map_filter(fields, lambda k, _: ~k.rlike(r"^[_$.#@]")))
