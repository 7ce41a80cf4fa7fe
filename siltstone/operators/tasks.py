"""Query tasks, their evaluation, and reranked hits."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import collapsed, short_hash
from siltstone.schemas import Catalog

TASK = "task_id string, query string, intent string, source_type string, label_status string, split string, weight double, expected_operation string, expected_call_ids array<string>"
SOURCE_TYPES = ("curated", "production_log", "manual", "llm_bootstrap", "heuristic_bootstrap")


def normalized(tasks: DataFrame) -> DataFrame:
    """Tasks with defaults, an id from the query where none is given, distinct by the query's words (first wins, by ``ordinal``; only tables
    without that column, small ones made on the driver, are taken in the order of their rows)."""
    have = set(tasks.columns)
    text = lambda n, d: F.coalesce(F.nullif(F.trim(F.col(n)), F.lit("")), F.lit(d)) if n in have else F.lit(d)
    t = tasks.withColumn("query", collapsed("query")).where("query <> ''")
    key = F.lower("query")
    kind = text("source_type", "manual")
    out = t.select(
        (F.col("ordinal") if "ordinal" in have else F.monotonically_increasing_id()).alias("ordinal"), key.alias("key"), text("task_id", "").alias("task_id"), "query", text("intent", "unspecified").alias("intent"), F.when(kind.isin(*SOURCE_TYPES), kind).otherwise("manual").alias("source_type"),
        text("label_status", "unlabeled").alias("label_status"), text("split", "dev").alias("split"), text("provenance", "unknown").alias("provenance"), text("generation_id", "").alias("generation_id"), (F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in have else F.lit(1.0)).alias("weight"), (F.col("expected_operation") if "expected_operation" in have else F.lit(None).cast("string")).alias("expected_operation"),
    )
    best = out.groupBy("key").agg(F.min_by(F.struct(*[c for c in out.columns if c != "key"]), "ordinal").alias("r"))
    return best.select("key", "r.*").withColumn("task_id", F.when(F.col("task_id") == "", F.concat(F.lit("task-"), short_hash("key", 16))).otherwise(F.col("task_id"))).drop("key")


def bootstrap(catalog: Catalog, most: int = 6) -> list[dict[str, Any]]:
    """Questions that a catalog suggests: a count per aggregatable field, a filter per first real value."""
    out = []
    for s in catalog.fields.values():
        label = s.name.replace("_", " ")
        if s.aggregatable:
            out.append({"query": f"How many calls by {label}?", "expected_operation": "aggregate", "source_type": "heuristic_bootstrap"})
        value = next((v for v in s.allowed_values if v != "not_mentioned"), None)
        if s.filterable and value:
            out.append({"query": f"Find calls with {label} {value.replace('_', ' ')}", "expected_operation": "filter", "source_type": "heuristic_bootstrap"})
    return out[:most]


def source_counts(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("source_type").agg(F.count(F.lit(1)).alias("count")).orderBy("source_type")


def scored(results: DataFrame) -> DataFrame:
    """(task_id, expected_call_ids, call_ids) -> (task_id, missing, passed): passed if nothing expected is missing."""
    none = F.array().cast("array<string>")
    missing = F.array_except(F.coalesce("expected_call_ids", none), F.coalesce("call_ids", none))
    return results.select("task_id", missing.alias("missing"), (F.size(missing) == 0).alias("passed"))


def pass_rate(results: DataFrame) -> DataFrame:
    return scored(results).agg(F.count(F.lit(1)).alias("tasks"), F.count_if("passed").alias("passed"), F.round(F.avg(F.col("passed").cast("double")), 4).alias("pass_rate"))


def rerank(hits: DataFrame, ranking: list[dict[str, Any]], id_col: str = "chunk_id") -> DataFrame:
    """Hits in a given order [{chunk_id, relevance, reason}]: unknown and repeated ids go, relevance is clamped to 0..1."""
    rows, seen = [], set()
    for r in ranking:
        i = str(r.get("chunk_id"))
        try:
            rel = float(r.get("relevance", 0.0))
        except (TypeError, ValueError):
            rel = 0.0
        if i not in seen:
            seen.add(i)
            rows.append((len(rows), i, min(1.0, max(0.0, rel)) if rel == rel else 0.0, str(r.get("reason", ""))))
    if not rows:
        raise ValueError("a ranking names no chunk")
    order = hits.sparkSession.createDataFrame(rows, f"pos int, {id_col} string, relevance double, reason string")
    known = hits.withColumn(id_col, F.col(id_col).cast("string"))
    return known.join(F.broadcast(order), id_col).withColumn("relevance", F.round("relevance", 6)).orderBy("pos")


def loop_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """(task_id, success, used_filter) before and after a refinement -> totals and gains; a task of either side counts."""
    both = before.select("task_id", F.col("success").alias("s0"), F.col("used_filter").alias("f0")).join(after.select("task_id", F.col("success").alias("s1"), F.col("used_filter").alias("f1")), "task_id", "full")
    n = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    return both.agg(F.count(F.lit(1)).alias("tasks"), n("s0").alias("success_before"), n("s1").alias("success_after"), (n("s1") - n("s0")).alias("success_delta"), (n("f1") - n("f0")).alias("filter_delta"))


def load_records(text: str) -> list[dict[str, Any]]:
    """Tasks in JSONL, a JSON array, an object that holds a list, or one object."""
    stripped = text.strip()
    if not stripped:
        return []
    try:
        got = json.loads(stripped)
    except ValueError:
        got = [json.loads(line) for line in stripped.splitlines() if line.strip()]
    if isinstance(got, dict):
        got = next((got[k] for k in ("tasks", "queries", "items", "records") if isinstance(got.get(k), list)), [got])
    return [g if isinstance(g, dict) else {"query": str(g)} for g in got]
