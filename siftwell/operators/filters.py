"""Nested filter languages compiled to Spark column expressions.

The main language has leaves ``{"field", "operator", "value"}`` and nodes ``{"operator": AND | OR | NOT,
"conditions"}``. NOT is compiled by inverting the tree, so that the rules for nulls hold inside it;
a doubled NOT cancels out. NOT over several conditions negates their conjunction.

The older language is Mongo-like (``$and``, ``$or``, ``$not``, ``$eq``, ...). In it a missing field makes every
comparison false, also the negative ones, and NOT over several conditions means none of them.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType, TimestampType


class FilterError(ValueError):
    """A filter that can't be compiled."""


def _path(df_schema: StructType, field: str) -> str:
    """``meta.x`` names the struct's field; a bare name is looked up at the top, then in ``meta``."""
    bare = field.removeprefix("meta.")
    names = df_schema.fieldNames()
    inside = "meta" in names and isinstance(df_schema["meta"].dataType, StructType) and bare in df_schema["meta"].dataType.fieldNames()
    if field != bare and inside:
        return f"meta.{bare}"
    if bare in names:
        return bare
    return f"meta.{bare}" if inside else bare


def _type(schema: StructType, path: str):
    kind: Any = schema
    for part in path.split("."):
        kind = kind[part].dataType if isinstance(kind, StructType) and part in kind.fieldNames() else None
    return kind


def _date(value: Any) -> datetime | None:
    if isinstance(value, datetime):
        return value
    try:
        return datetime.fromisoformat(value) if isinstance(value, str) else None
    except ValueError:
        return None


def _literal(kind, value: Any) -> Column:
    if isinstance(kind, TimestampType) and isinstance(value, str) and (d := _date(value)) is not None:
        return F.lit(d)
    return F.lit(value)


def _ordered(compare: Callable[[Column, Column], Column]):
    def build(c: Column, kind, value: Any) -> Column:
        if value is None:
            return F.lit(False)
        if isinstance(value, list):
            raise FilterError("a list can't be compared by order")
        if isinstance(value, str) and _date(value) is None:
            raise FilterError("text other than ISO dates can't be compared by order")
        return compare(c, _literal(kind, value))

    return build


def _any(c: Column, kind, value: Any) -> Column:
    if not isinstance(value, list):
        raise FilterError("'in' and 'not in' take a list")
    if isinstance(kind, ArrayType):
        return F.arrays_overlap(c, F.array(*(F.lit(v) for v in value)))
    return c.isin(*value) if value else F.lit(False)


def _equal(c: Column, kind, value: Any) -> Column:
    if value is None:
        return c.isNull()
    if isinstance(kind, ArrayType) and not isinstance(value, list):
        return F.array_contains(c, value)
    return c == _literal(kind, value)


def _not_equal(c: Column, kind, value: Any) -> Column:
    return c.isNotNull() if value is None else ~_equal(c, kind, value) | c.isNull()


COMPARISONS: dict[str, Callable[[Column, Any, Any], Column]] = {
    "==": _equal,
    "!=": _not_equal,
    ">": _ordered(lambda a, b: a > b),
    ">=": _ordered(lambda a, b: a >= b),
    "<": _ordered(lambda a, b: a < b),
    "<=": _ordered(lambda a, b: a <= b),
    "in": _any,
    "not in": lambda c, kind, value: ~_any(c, kind, value),
}
# Operators and their negations.
NEGATIONS = (("==", "!="), (">", "<="), (">=", "<"), ("in", "not in"))
INVERSE = dict(NEGATIONS) | {b: a for a, b in NEGATIONS}


def _leaf(schema: StructType, f: dict, inverted: bool) -> Column:
    for key in ("operator", "value"):
        if key not in f:
            raise FilterError(f"{key!r} is missing in {f}")
    op = f["operator"]
    if op not in COMPARISONS:
        raise KeyError(op)
    path = _path(schema, f["field"])
    return COMPARISONS[INVERSE[op] if inverted else op](F.col(path), _type(schema, path), f["value"])


def _node(schema: StructType, f: Any, inverted: bool) -> Column:
    if not isinstance(f, dict):
        raise FilterError("a filter is a dict")
    if "field" in f:
        return _leaf(schema, f, inverted)
    for key in ("operator", "conditions"):
        if key not in f:
            raise FilterError(f"{key!r} is missing in {f}")
    op = f["operator"]
    if op not in ("AND", "OR", "NOT"):
        raise FilterError(f"unknown logical operator {op!r}")
    flip = inverted != (op == "NOT")
    parts = [_node(schema, c, flip) for c in f["conditions"]]
    conjunction = (op in ("AND", "NOT")) != flip
    if not parts:
        return F.lit(conjunction)
    return reduce(lambda a, b: a & b if conjunction else a | b, parts)


def compile_filter(schema: StructType, filters: dict | None) -> Column:
    """The condition; no filter keeps every row."""
    return F.lit(True) if filters is None else _node(schema, filters, False)


def apply_filter(df: DataFrame, filters: dict | None) -> DataFrame:
    return df if filters is None else df.where(compile_filter(df.schema, filters))


def equals_all(values: str | list[str] | None, field: str) -> dict | None:
    """Strings to a conjunction of equalities over one field."""
    if values is None:
        return None
    values = [values] if isinstance(values, str) else values
    return {"operator": "AND", "conditions": [{"field": field, "operator": "==", "value": v} for v in values]}


# The older language.

_LOGICAL = ("$and", "$or", "$not")
_LEGACY: dict[str, Callable[[Column, Any], Column]] = {
    "$eq": lambda c, v: c == F.lit(v),
    "$ne": lambda c, v: c != F.lit(v),
    "$gt": lambda c, v: c > F.lit(v),
    "$gte": lambda c, v: c >= F.lit(v),
    "$lt": lambda c, v: c < F.lit(v),
    "$lte": lambda c, v: c <= F.lit(v),
    "$in": lambda c, v: c.isin(*v),
    "$nin": lambda c, v: ~c.isin(*v),
}


def _legacy_value(v: Any) -> Any:
    if isinstance(v, DataFrame):  # a table as value is compared in its JSON form
        return "[" + ",".join(r[0] for r in v.select(F.to_json(F.struct("*"))).collect()) + "]"
    return v


def _legacy(schema: StructType, f: Any, field: str | None) -> list[Column]:
    if isinstance(f, list):
        return [reduce(lambda a, b: a & b, _legacy(schema, x, field)) for x in f]
    if not isinstance(f, dict):
        raise FilterError("a filter is a dict or a list of them")
    out = []
    for key, v in f.items():
        if key in _LOGICAL:
            parts = _legacy(schema, v, field)
            if key == "$not":
                out.append(~reduce(lambda a, b: a | b, parts))
            else:
                out.append(reduce((lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b), parts))
        elif key in _LEGACY:
            if field is None:
                raise FilterError(f"{key} stands outside a field")
            path = _path(schema, field)
            out.append(F.coalesce(_LEGACY[key](F.col(path), _legacy_value(v)), F.lit(False)) if _type(schema, path) is not None else F.lit(False))
        elif isinstance(v, dict):
            out += _legacy(schema, v, key)
        else:
            out += _legacy(schema, {"$in" if isinstance(v, list) else "$eq": v}, key)
    return out


def compile_legacy(schema: StructType, filters: dict) -> Column:
    """Conditions side by side are a conjunction; a bare value means ``$eq``, a bare list ``$in``."""
    return reduce(lambda a, b: a & b, _legacy(schema, filters, None))


def to_sql(f: dict, quote: Callable[[Any], str] = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'", inverted: bool = False) -> str:
    """The main language as a SQL condition."""
    if "field" in f:
        op, v, c = INVERSE[f["operator"]] if inverted else f["operator"], f["value"], f["field"].removeprefix("meta.")
        if op in ("in", "not in"):
            return f"{c} {op.upper()} ({', '.join(map(quote, v))})"
        if v is None:
            return f"{c} IS NULL" if op == "==" else f"{c} IS NOT NULL" if op == "!=" else "FALSE"
        if op == "!=":
            return f"({c} <> {quote(v)} OR {c} IS NULL)"
        return f"{c} {'=' if op == '==' else op} {quote(v)}"
    flip = inverted != (f["operator"] == "NOT")
    word = " AND " if (f["operator"] in ("AND", "NOT")) != flip else " OR "
    return "(" + word.join(to_sql(c, quote, flip) for c in f["conditions"]) + ")"
