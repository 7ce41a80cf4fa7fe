"""The aggregate-expression language, compiled to DataFrame plans.

An expression is parsed, every node checked against an allow-list, its fields bound to
the catalog, and then compiled: all scalar parts of an expression become columns of one ``agg`` over one scan.
Nothing is evaluated as Python.
"""

from __future__ import annotations

import ast
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import EMPTY, numeric_value, parse_date
from siltstone.operators.filters import compared, in_dates, in_range
from siltstone.schemas import Catalog

GRAINS = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}


def values_of(df: DataFrame, name: str) -> Column:
    """A field's values as an array of strings; null, "", false, 0 and ``not_mentioned`` are no values."""
    c, kind = F.col(name), df.schema[name].dataType.simpleString()
    none = F.array().cast("array<string>")
    if kind.startswith("array"):
        return F.coalesce(F.filter(c.cast("array<string>"), lambda v: v.isNotNull() & ~v.isin(*EMPTY)), none)
    if kind == "boolean":
        return F.when(c, F.array(F.lit("True"))).otherwise(none)
    if kind == "string":
        return F.when(c.isNotNull() & ~c.isin(*EMPTY), F.array(c)).otherwise(none)
    return F.when(c.isNotNull() & (c != 0), F.array(c.cast("string"))).otherwise(none)


def group_count(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.explode(values_of(df, name)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "key")


def top_k(df: DataFrame, name: str, k: int = 5, order: str = "ordinal") -> DataFrame:
    """The cut prefers, among equal counts, what occurs first; what is left is shown by count and key."""
    each = df.select(F.col(order).alias("o"), F.posexplode(values_of(df, name)).alias("p", "key"))
    counted = each.groupBy("key").agg(F.count(F.lit(1)).alias("count"), F.min(F.struct("o", "p")).alias("first"))
    return counted.orderBy(F.desc("count"), "first").limit(max(1, int(k))).select("key", "count").orderBy(F.desc("count"), "key")


def nested_group_count(df: DataFrame, names: list[str]) -> DataFrame:
    """Counts by every combination of the fields' values; rows with an empty field don't count."""
    out = df.select(*[values_of(df, n).alias(f"v{i}") for i, n in enumerate(names)])
    keys = [f"key{i + 1}" for i in range(len(names))]
    for i, k in enumerate(keys):
        out = out.withColumn(k, F.explode(f"v{i}"))
    return out.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).orderBy(*keys[:-1], F.desc("count"), keys[-1])


def cohort_count(df: DataFrame, grain: str = "month", date: str = "date") -> DataFrame:
    if grain not in GRAINS:
        raise ValueError(f"granularity not allowed: {grain}")
    d = parse_date(date)
    return df.where(d.isNotNull()).groupBy(F.date_format(d, GRAINS[grain]).alias("key")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "key")


def holds(df: DataFrame, name: str, expected: Any) -> Column:
    """A list field contains the value, a scalar equals it."""
    c, kind = F.col(name), df.schema[name].dataType.simpleString()
    if kind.startswith("array"):
        return F.coalesce(F.array_contains(c, F.lit(expected)), F.lit(False))
    if kind == "boolean":
        return F.coalesce(c == F.lit(bool(expected)), F.lit(False)) if expected in (0, 1) else F.lit(False)
    if kind == "string":
        return F.coalesce(c == F.lit(expected), F.lit(False)) if isinstance(expected, str) else F.lit(False)
    return F.coalesce(c == F.lit(expected), F.lit(False)) if isinstance(expected, (int, float)) else F.lit(False)


def range_count(df: DataFrame, hit: Column, id_col: str = "call_id", order: str = "ordinal", most: int = 20) -> DataFrame:
    """(count, record_ids): the ids come from a top-k, not from a list of all."""
    rows = df.where(hit)
    ids = rows.select(order, id_col).orderBy(order).limit(most).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, id_col))), lambda p: p[id_col]).alias("record_ids"))
    return rows.agg(F.count(F.lit(1)).alias("count")).crossJoin(F.broadcast(ids))


def ratio(numerator: Column, denominator: Column, precision: int = 4) -> Column:
    return F.round(F.try_divide(numerator.cast("double"), denominator.cast("double")), precision)


def evidence_refs(df: DataFrame, names: list[str], limit: int = 24, order: str = "ordinal", refs: str = "evidence_refs") -> DataFrame:
    """Distinct refs of the fields, by row, then field, then place; the first ``limit``."""
    per = F.array(*[F.struct(F.lit(i).alias("f"), F.coalesce(F.try_element_at(F.col(refs), F.lit(n)), F.array().cast("array<string>")).alias("r")) for i, n in enumerate(names)])
    each = df.select(F.col(order).alias("o"), F.explode(per).alias("x")).select("o", F.col("x.f").alias("f"), F.posexplode("x.r").alias("p", "ref"))
    return each.groupBy("ref").agg(F.min(F.struct("o", "f", "p")).alias("first")).orderBy("first").limit(limit).select("ref", F.col("first.o").alias("ordinal"))


# ---- expressions -------------------------------------------------------------------------------

#: Field arguments by function: (positions, keyword).
_FIELDS = {"group_count": (1, "field"), "top_k": (1, "field"), "nested_group_count": (1, "fields"), "count_if": (1, "field"), "count_where": (1, "field"), "numeric_range_count": (1, "field")}
_PARAMS = {
    "count": ("records",), "group_count": ("records", "field"), "top_k": ("records", "field", "k"), "nested_group_count": ("records", "fields"), "count_if": ("records", "field", "expected"),
    "count_where": ("records", "field", "operator", "value"), "numeric_range_count": ("records", "field", "min_value", "max_value"), "date_range_count": ("records", "start", "end"), "cohort_count": ("records", "date_granularity"), "ratio": ("numerator", "denominator", "precision"),
}
_ALLOWED = (ast.Expression, ast.Load, ast.Constant, ast.List, ast.Tuple, ast.keyword, ast.UnaryOp, ast.UAdd, ast.USub, ast.Name, ast.Call)


@dataclass
class Compiled:
    """``frame`` holds the result; ``kind`` is scalar, table, range, list or rows."""

    frame: DataFrame
    kind: str
    used_fields: list[str]


def _literal(node: ast.expr) -> Any:
    try:
        return ast.literal_eval(node)
    except ValueError as e:
        raise ValueError("arguments must be literal") from e


def _arguments(call: ast.Call) -> dict[str, ast.expr]:
    name = call.func.id
    names = _PARAMS[name]
    if len(call.args) > len(names):
        raise ValueError(f"{name}: too many arguments")
    got = dict(zip(names, call.args))
    for k in call.keywords:
        if k.arg not in names or k.arg in got:
            raise ValueError(f"{name}: argument not allowed: {k.arg}")
        got[k.arg] = k.value
    return got


def validate(expression: str, catalog: Catalog) -> tuple[ast.expr, list[str]]:
    """Parses and checks an expression; returns its tree and the sorted fields it uses."""
    try:
        tree = ast.parse(expression.strip(), mode="eval")
    except SyntaxError as e:
        raise ValueError(f"not an expression: {expression!r}") from e
    used: set[str] = set()
    for node in ast.walk(tree):
        if not isinstance(node, _ALLOWED):
            raise ValueError(f"not allowed in an expression: {type(node).__name__}")
        if isinstance(node, ast.Name) and node.id != "records" and node.id not in _PARAMS:
            raise ValueError(f"name not allowed: {node.id}")
        if isinstance(node, ast.UnaryOp) and not isinstance(node.operand, ast.Constant):
            raise ValueError("a sign must stand before a constant")
        if isinstance(node, ast.Call):
            if not isinstance(node.func, ast.Name) or node.func.id not in _PARAMS:
                raise ValueError("only aggregate functions may be called")
            if node.func.id in _FIELDS:
                given = _arguments(node).get(_FIELDS[node.func.id][1])
                names = _literal(given) if given is not None else None
                names = list(names) if isinstance(names, (list, tuple)) else [names]
                if not all(isinstance(n, str) for n in names):
                    raise ValueError("fields must be literal names")
                for n in names:
                    if not catalog[n].aggregatable:
                        raise ValueError(f"field can't be aggregated: {n}")
                    used.add(n)
    return tree.body, sorted(used)


def _one_row(df: DataFrame, out: list[Column], apart: list[DataFrame]) -> DataFrame:
    """All aggregates of an expression as one row: those of the rows themselves in one pass, the others joined row to row."""
    made = df.agg(*out) if out else df.sparkSession.range(1)
    for other in apart:
        made = made.crossJoin(F.broadcast(other))
    return made


def _scalar(df: DataFrame, node: ast.expr, out: list[Column], apart: list[DataFrame]) -> Column:
    """Compiles a scalar part; what must be aggregated is added to ``out``, or to ``apart`` where it counts exploded values, and referred to by name."""
    if isinstance(node, (ast.Constant, ast.UnaryOp)):
        return F.lit(_literal(node))
    if not isinstance(node, ast.Call):
        raise ValueError("a number is needed here")
    name, a = node.func.id, _arguments(node)

    def later(c: Column) -> Column:
        out.append(c.alias(f"_{len(out)}"))
        return F.col(f"_{len(out) - 1}")

    if name == "count":
        inner = a.get("records")
        if isinstance(inner, ast.Call) and inner.func.id == "group_count":
            field = _literal(_arguments(inner)["field"])
            if df.schema[field].dataType.simpleString().startswith("array"):
                apart.append(df.select(F.explode(values_of(df, field)).alias("v")).agg(F.count_distinct("v").alias(f"_apart{len(apart)}")))
                return F.col(f"_apart{len(apart) - 1}")
            return later(F.count_distinct(F.get(values_of(df, field), F.lit(0))))
        if not isinstance(inner, ast.Name):
            raise ValueError("count takes records or a group_count")
        return later(F.count(F.lit(1)))
    if name == "count_if":
        return later(F.count_if(holds(df, _literal(a["field"]), _literal(a["expected"]))))
    if name == "count_where":
        return later(F.count_if(compared(df, _literal(a["field"]), _literal(a["operator"]), _literal(a["value"]))))
    raise ValueError(f"{name} doesn't give a number")


def evaluate(expression: str, df: DataFrame, catalog: Catalog) -> Compiled:
    """Compiles ``expression`` over silver rows ``df`` (filtered, unlimited)."""
    tree, used = validate(expression, catalog)
    if isinstance(tree, ast.Name) and tree.id == "records":
        return Compiled(df, "rows", used)
    if isinstance(tree, ast.Call):
        name, a = tree.func.id, _arguments(tree)
        arg = lambda k, default=None: _literal(a[k]) if k in a else default
        if name == "group_count":
            return Compiled(group_count(df, arg("field")), "table", used)
        if name == "top_k":
            return Compiled(top_k(df, arg("field"), arg("k", 5)), "table", used)
        if name == "nested_group_count":
            return Compiled(nested_group_count(df, list(arg("fields"))), "table", used)
        if name == "cohort_count":
            return Compiled(cohort_count(df, arg("date_granularity", "month")), "table", used)
        if name == "numeric_range_count":
            field, low, high = arg("field"), arg("min_value"), arg("max_value")
            hit = in_range(numeric_value(field, df.schema[field].dataType.simpleString()), low, high)
            return Compiled(range_count(df, hit).select("count", F.lit(field).alias("field"), F.lit(low).cast("double").alias("min"), F.lit(high).cast("double").alias("max"), "record_ids"), "range", used)
        if name == "date_range_count":
            start, end = arg("start"), arg("end")
            return Compiled(range_count(df, in_dates("date", start, end)).select("count", F.lit(start).alias("start"), F.lit(end).alias("end"), "record_ids"), "range", used)
        if name == "count" and isinstance(a.get("records"), ast.Call) and a["records"].func.id == "group_count":
            field = _literal(_arguments(a["records"])["field"])
            return Compiled(df.select(F.explode(values_of(df, field)).alias("v")).agg(F.count_distinct("v").alias("result")), "scalar", used)
        out: list[Column] = []
        apart: list[DataFrame] = []
        if name == "ratio":
            n, d = _scalar(df, a["numerator"], out, apart), _scalar(df, a["denominator"], out, apart)
            p = arg("precision", 4)
            made = _one_row(df, out, apart).select(n.alias("numerator"), d.alias("denominator"))
            return Compiled(made.withColumn("ratio", ratio(F.col("numerator"), F.col("denominator"), int(p))), "ratio", used)
        value = _scalar(df, tree, out, apart)
        return Compiled(_one_row(df, out, apart).select(value.alias("result")), "scalar", used)
    if isinstance(tree, (ast.List, ast.Tuple)):
        out, apart = [], []
        cols = [_scalar(df, x, out, apart) for x in tree.elts]
        return Compiled(_one_row(df, out, apart).select(F.array(*[c.cast("double") for c in cols]).alias("result")), "list", used)
    raise ValueError("an expression must call an aggregate function")


def aggregate_silver(df: DataFrame, catalog: Catalog, group_by: str | None = None, expression: str | None = None) -> Compiled:
    """An expression if given, else counts by ``group_by``."""
    if expression:
        return evaluate(expression, df, catalog)
    if group_by is None:
        raise ValueError("group_by or an expression is needed")
    if not catalog[group_by].aggregatable:
        raise ValueError(f"field can't be aggregated: {group_by}")
    return Compiled(group_count(df, group_by), "table", [group_by])

