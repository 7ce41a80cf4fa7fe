"""The loop from questions to a better schema and back: runs, sessions, their artifacts and reports."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable
from dataclasses import asdict
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.feedback import SENSITIVE, value_counts
from siltstone.plans.agent import Agent, Corpus
from siltstone.plans.planner import feedback_specs
from siltstone.schemas import Catalog

RESULT = "phase string, task_id string, query string, operation string, planner string, success boolean, used_filter boolean, confidence string, failure_modes array<string>, record_count int, evidence_count int, request_count int, input_tokens long, output_tokens long"


def task_id(query: str) -> str:
    return "task-" + re.sub("[^a-z0-9]+", "-", query.lower()).strip("-")[:40]


def result_row(phase: str, answer: dict[str, Any], tokens: tuple[int, int] = (0, 0)) -> dict[str, Any]:
    judged, plan = answer["judgement"], answer["plan"]
    return {
        "phase": phase, "task_id": task_id(answer["query"]), "query": answer["query"], "operation": plan.operation, "planner": plan.planner, "success": judged["success"], "used_filter": bool(plan.filters), "confidence": judged["confidence"],
        "failure_modes": judged["failure_modes"], "record_count": len(answer["records"]), "evidence_count": len(answer["evidence"]), "request_count": len(answer["column_requests"]), "input_tokens": tokens[0], "output_tokens": tokens[1],
    }


def run(corpus: Corpus, queries: list[str], refine: Callable[[Corpus, Catalog], Corpus] | None = None, ask: Callable[[Corpus, str], dict[str, Any]] | None = None) -> DataFrame:
    """Asks every question, takes what the answers ask for into the schema, has ``refine`` rebuild the corpus for it (without one the
    silver rows stay), and asks again: (phase before or after, ...), one row per question and phase."""
    ask = ask or (lambda c, q: Agent(c).answer(q))
    before = [ask(corpus, q) for q in queries]
    wishes = list({(r.action, r.field_name): r for a in before for r in a["column_requests"]}.values())
    better = Catalog.of(*feedback_specs(list(corpus.catalog.fields.values()), wishes)) if wishes else corpus.catalog
    refined = refine(corpus, better) if refine and wishes else corpus
    rows = [result_row("before", a) for a in before] + [result_row("after", ask(refined, q)) for q in queries]
    return corpus.silver.sparkSession.createDataFrame([tuple(r[f.split(" ")[0]] for f in RESULT.split(", ")) for r in rows], RESULT)


def totals(results: DataFrame) -> DataFrame:
    """By phase: questions, successes, filters used, evidence, requests and tokens."""
    return results.groupBy("phase").agg(F.count(F.lit(1)).alias("tasks"), F.count_if("success").alias("successes"), F.count_if("used_filter").alias("filters"), F.sum("evidence_count").alias("evidence"), F.sum("request_count").alias("requests"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def histograms(results: DataFrame, columns: tuple[str, ...] = ("operation", "confidence", "failure_modes")) -> DataFrame:
    """(column, key, count) of what was decided."""
    out = None
    for c in columns:
        one = value_counts(results, c).select(F.lit(c).alias("column"), "key", "count")
        out = one if out is None else out.unionByName(one)
    return out


def per_task(results: DataFrame) -> DataFrame:
    """Each question before and after; one that was only asked once stays."""
    pick = lambda p: results.where(F.col("phase") == p).select("task_id", *[F.col(c).alias(f"{c}_{p}") for c in ("success", "used_filter", "confidence")])
    return pick("before").join(pick("after"), "task_id", "full").orderBy("task_id")


def session_metrics(results: DataFrame) -> DataFrame:
    """One row for a session: questions, successes, questions that asked for feedback or evidence, and what they found."""
    return results.agg(F.count(F.lit(1)).alias("queries"), F.count_if("success").alias("successes"), F.count_if(F.col("request_count") > 0).alias("with_requests"), F.count_if(F.col("evidence_count") > 0).alias("with_evidence"), F.coalesce(F.sum("record_count"), F.lit(0)).alias("records"), F.round(F.avg(F.col("success").cast("double")), 4).alias("success_rate"))


def event(kind: str, at: int, **told: Any) -> dict[str, Any]:
    """An orchestration event; its numbers are what ``event_metrics`` adds up."""
    return {"ordinal": at, "kind": kind, "detail": json.dumps({k: v for k, v in told.items() if not isinstance(v, (int, float)) or isinstance(v, bool)}, sort_keys=True, default=str), "metrics": {k: float(v) for k, v in told.items() if isinstance(v, (int, float)) and not isinstance(v, bool)}}


EVENT = "ordinal long, kind string, detail string, metrics map<string,double>"


def events_table(spark: SparkSession, events: list[dict[str, Any]]) -> DataFrame:
    return spark.createDataFrame([(e["ordinal"], e["kind"], e["detail"], e["metrics"]) for e in events], EVENT)


def event_metrics(events: DataFrame) -> DataFrame:
    """(kind, metric, events, total)."""
    return events.select("kind", F.explode("metrics").alias("metric", "v")).groupBy("kind", "metric").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("v"), 6).alias("total"))


def safe_stem(text: str, most: int = 60) -> str:
    return re.sub("[^A-Za-z0-9._-]+", "_", text).strip("._")[:most] or "item"


def cut(text: str, most: int) -> str:
    return text if len(text) <= most else text[: max(0, most - 3)].rstrip() + "..."


def shown(value: Any) -> str:
    """A value as reports print it."""
    if isinstance(value, bool):
        return "yes" if value else "no"
    if value is None or value == "" or value == []:
        return "-"
    return ", ".join(map(shown, value)) if isinstance(value, (list, tuple)) else f"{value:g}" if isinstance(value, float) else str(value)


def hidden(value: Any) -> Any:
    """``value`` with what isn't empty under sensitive names left out, for replays."""
    if isinstance(value, dict):
        return {k: "[redacted]" if k in SENSITIVE and v not in (None, "", [], {}) else hidden(v) for k, v in value.items()}
    return [hidden(v) for v in value] if isinstance(value, (list, tuple)) else value


def publish(spark: SparkSession, path: str, answers: list[dict[str, Any]], results: DataFrame, events: list[dict[str, Any]]) -> None:
    """An answer and its replay per question, the summary, the events and a page to read."""
    from siltstone.sources.sinks import write_document, write_jsonl

    for a in answers:
        told = a | {"plan": asdict(a["plan"]), "column_requests": [asdict(r) for r in a["column_requests"]]}
        stem = safe_stem(task_id(a["query"]))
        write_document(spark, told, f"{path}/{stem}.json", default=str)
        write_document(spark, hidden(told), f"{path}/{stem}.replay.json", default=str)
    write_document(spark, {"phases": [r.asDict() for r in totals(results).orderBy("phase").collect()], "tasks": [r.asDict() for r in per_task(results).collect()]}, f"{path}/loop_summary.json")
    write_jsonl(events_table(spark, events), f"{path}/orchestration_trace.jsonl")
    spark.createDataFrame([(page(results),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/report.html")


def page(results: DataFrame, title: str = "Run report") -> str:
    """A static page: totals by phase, decisions, and each question before and after. Reports are of questions asked, so they are small."""
    def table(df: DataFrame) -> str:
        rows = "".join("<tr>" + "".join(f"<td>{html.escape(cut(shown(v), 120))}</td>" for v in r) + "</tr>" for r in df.collect())
        return "<table><tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in df.columns) + f"</tr>{rows}</table>"

    parts = {"Totals": totals(results).orderBy("phase"), "Decisions": histograms(results).orderBy("column", "key"), "Questions": per_task(results)}
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>" + "".join(f"<h2>{n}</h2>{table(d)}" for n, d in parts.items())

