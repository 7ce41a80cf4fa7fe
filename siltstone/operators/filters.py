"""Conjunctive filters over silver rows: validated on the driver, compiled to one Column that Catalyst pushes down."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from siltstone.functions.text import numeric_value, parse_date
from siltstone.schemas import Catalog

OPERATORS = ("==", "!=", ">", ">=", "<", "<=")


def validate_filters(filters: dict[str, Any], catalog: Catalog) -> dict[str, Any]:
    """Empty values are dropped; unknown or unfilterable fields and values outside a vocabulary raise."""
    out: dict[str, Any] = {}
    for name, value in filters.items():
        if value is None or value == "" or value == [] or value == "null":
            continue
        spec = catalog[name]
        if not spec.filterable:
            raise ValueError(f"field can't be filtered: {name}")
        if spec.type == "boolean":
            if isinstance(value, str) and value.lower() in ("true", "false"):
                value = value.lower() == "true"
            if value not in (True, False):
                raise ValueError(f"{name}: not a boolean: {value!r}")
            value = bool(value)
        for v in value if isinstance(value, list) else [value]:
            if spec.type in ("enum", "list") and spec.allowed_values and v not in spec.allowed_values:
                raise ValueError(f"{name}: value not allowed: {v}")
        out[name] = value
    return out


def matches(df: DataFrame, name: str, expected: Any) -> Column:
    """List fields contain a scalar or overlap a list; scalars equal a scalar, nulls a None; a
    scalar never equals a list. Null elements don't make a row unknown."""
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, ArrayType):
        hit = F.arrays_overlap(c, F.array(*map(F.lit, expected))) if isinstance(expected, list) else F.array_contains(c, F.lit(expected))
        return F.coalesce(hit, F.lit(False))
    if isinstance(expected, list):
        return F.lit(False)
    if isinstance(kind, BooleanType) and expected in (0, 1) and expected is not None:
        expected = bool(expected)
    if isinstance(expected, bool) and not isinstance(kind, BooleanType):
        expected = int(expected)
    return c.eqNullSafe(F.lit(expected))


def query_silver(df: DataFrame, filters: dict[str, Any] | None = None, limit: int | None = None, order: str = "ordinal") -> DataFrame:
    """Rows that match all of ``filters``; with ``limit`` the first so many by ``order``."""
    hit = reduce(lambda a, b: a & b, (matches(df, k, v) for k, v in (filters or {}).items()), F.lit(True))
    out = df.where(hit)
    return out if limit is None else out.orderBy(order).limit(limit)


def compared(df: DataFrame, name: str, operator: str, expected: Any) -> Column:
    """Typed comparison: by number where both sides are numbers, else only == and != on the values."""
    if operator not in OPERATORS:
        raise ValueError(f"operator not allowed: {operator}")
    c, kind = F.col(name), df.schema[name].dataType.simpleString()
    number = None
    if not isinstance(expected, bool):
        try:
            number = float(expected)
        except (TypeError, ValueError):
            number = None
    if kind.startswith("array"):
        raw = F.lit(operator == "!=") if not isinstance(expected, list) else (c == F.array(*map(F.lit, expected))) if operator == "==" else (c != F.array(*map(F.lit, expected)))
    elif kind == "boolean" and isinstance(expected, bool) or kind == "string" and isinstance(expected, str):
        raw = {"==": c.eqNullSafe(F.lit(expected)), "!=": ~c.eqNullSafe(F.lit(expected))}.get(operator, F.lit(False))
    else:
        raw = F.lit(operator == "!=")
    if number is None or number != number:
        return F.coalesce(raw, F.lit(operator == "!="))
    n, e = numeric_value(name, kind), F.lit(number)
    by_number = {"==": n == e, "!=": n != e, ">": n > e, ">=": n >= e, "<": n < e, "<=": n <= e}[operator]
    return F.when(n.isNotNull(), by_number).otherwise(F.coalesce(raw, F.lit(operator == "!=")))


def in_range(value: Column, low: Any = None, high: Any = None) -> Column:
    """Inclusive; either end may be open; nulls are outside."""
    hit = value.isNotNull()
    if low is not None:
        hit = hit & (value >= low)
    if high is not None:
        hit = hit & (value <= high)
    return hit


def in_dates(column: str, start: str | None = None, end: str | None = None) -> Column:
    day = lambda s: F.lit(s).cast("date")
    return in_range(parse_date(column), day(start) if start else None, day(end) if end else None)
