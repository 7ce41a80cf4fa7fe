"""JSON whose fields have no one type, as VARIANT: every value keeps the type that it came with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(text: str | Column) -> Column:
    """JSON text as a variant; null where it isn't JSON."""
    return F.try_parse_json(text if isinstance(text, Column) else F.col(text))


def read_jsonl(spark, path: str) -> DataFrame:
    """(ordinal columns of the file, value): every line of JSONL files as a variant, blank lines passed over. Nothing is inferred, so a field that is a number here and a text
    there stays both."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    return lines.select(F.col("_metadata.file_path").alias("source_file"), parsed("value").alias("value"), F.when(F.try_parse_json("value").isNull(), F.col("value")).alias("broken"))


def schema_of(rows: DataFrame, column: str) -> str:
    """The type that holds all values of a variant column, as DDL."""
    return rows.agg(F.schema_of_variant_agg(column)).first()[0]


def typed(value: str | Column, path: str) -> Column:
    """A struct (kind, string, number, flag, json) of one field of a variant. kind is number, string, boolean, array, object, null, or missing; the value stands under its own type, arrays
    and objects as JSON. Nothing is turned into text that wasn't."""
    v = F.try_variant_get(value if isinstance(value, Column) else F.col(value), path, "variant")
    told = F.schema_of_variant(v)
    kind = (
        F.when(v.isNull(), "missing").when(F.is_variant_null(v), "null").when(told == "STRING", "string").when(told == "BOOLEAN", "boolean")
        .when(told.startswith("ARRAY"), "array").when(told.startswith("OBJECT"), "object").otherwise("number")
    )
    as_ = lambda t: F.try_variant_get(v, "$", t)
    return F.struct(
        kind.alias("kind"), F.when(kind == "string", as_("string")).alias("string"), F.when(kind == "number", as_("double")).alias("number"),
        F.when(kind == "boolean", as_("boolean")).alias("flag"), F.when(kind.isin("array", "object"), as_("string")).alias("json"),
    )


def silver_rows(rows: DataFrame, column: str, fields: dict[str, str], keep: tuple[str, ...] = ()) -> DataFrame:
    """One struct per field (name -> path), typed as its value came: a silver row that comparisons can read without guessing."""
    return rows.select(*keep, *[typed(column, p).alias(n) for n, p in fields.items()])


def compared(field: str, op: str, value: float | str | bool) -> Column:
    """A typed field against a value of one type: values of another type never match, so '10' isn't 10."""
    part = F.col(f"{field}.flag") if isinstance(value, bool) else F.col(f"{field}.string") if isinstance(value, str) else F.col(f"{field}.number")
    ops = {"==": part == value, "!=": part != value, ">": part > value, ">=": part >= value, "<": part < value, "<=": part <= value}
    if op not in ops:
        raise ValueError(f"comparison not allowed: {op}")
    return F.coalesce(ops[op], F.lit(False))
