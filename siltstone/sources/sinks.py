"""Publishing and opening a corpus: tables as Parquet, documents as JSON through Spark's own file systems."""

from __future__ import annotations

import json
from dataclasses import asdict
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import negotiation
from siltstone.operators.feedback import redacted
from siltstone.operators.silver import SCHEMA_VERSION
from siltstone.plans import contracts
from siltstone.plans.agent import Corpus
from siltstone.schemas import Catalog, FieldSpec
from siltstone.sources.calls import numbered

TABLES = ("chunks", "field_extractions", "silver_calls")
DOCUMENTS = ("manifest", "catalog", "quality_report", "extraction_contract", "platform_contract", "evaluation_tasks", "field_candidates", "schema_negotiation", "artifact")


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object a line, keys in alphabetical order."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def write_document(spark: SparkSession, value: Any, path: str, **how: Any) -> None:
    spark.createDataFrame([(json.dumps(value, ensure_ascii=False, sort_keys=True, **how),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str) -> Any:
    return json.loads(spark.read.text(path).first()["value"])


def publish(path: str, catalog: Catalog, chunks: DataFrame, extractions: DataFrame, silver: DataFrame, report: DataFrame, trace: DataFrame | None = None, feedback: DataFrame | None = None) -> None:
    """The artifacts of a run: tables, catalog, quality and feedback reports, field candidates and how they were decided, contracts, evaluation tasks, digests, and the
    trace with sensitive values hidden."""
    spark = silver.sparkSession
    for name, df in zip(TABLES, (chunks, extractions, silver)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    write_document(spark, [asdict(s) for s in catalog.fields.values()], f"{path}/catalog")
    write_document(spark, {r["field_name"]: r.asDict() for r in report.collect()}, f"{path}/quality_report")
    counts = {n: spark.read.parquet(f"{path}/{n}").count() for n in TABLES}
    specs = list(catalog.fields.values())
    contract = contracts.extraction_contract(specs)
    digest = contracts.dataset_digest(spark.read.parquet(f"{path}/silver_calls"), "call_id")
    write_document(spark, {"counts": counts, "fields": list(catalog.fields), "dataset_digest": digest, "contract_hash": contract["contract_hash"]}, f"{path}/manifest")
    contracts.manifest_records(spark.read.parquet(f"{path}/silver_calls"), spark.read.parquet(f"{path}/chunks")).write.mode("overwrite").parquet(f"{path}/manifest_records")
    write_jsonl(spark.createDataFrame([(json.dumps(asdict(s), sort_keys=True),) for s in specs] or [], "spec string"), f"{path}/field_specs")
    write_document(spark, contract, f"{path}/extraction_contract")
    write_document(spark, contracts.platform_contract(specs), f"{path}/platform_contract")
    write_document(spark, contracts.evaluation_tasks(spark.read.parquet(f"{path}/silver_calls"), catalog), f"{path}/evaluation_tasks")
    wishes = feedback if feedback is not None else spark.createDataFrame([], "field_name string, count long")
    decided = negotiation.candidates(report, wishes)
    write_document(spark, [negotiation.candidate_details(s) for s in specs], f"{path}/field_candidates")
    write_document(spark, [r.asDict() for r in decided.orderBy("field_name").collect()], f"{path}/schema_negotiation")
    if feedback is not None:
        feedback.write.mode("overwrite").parquet(f"{path}/feedback_report")
    write_document(spark, {"artifact": "silver corpus", "schema_version": SCHEMA_VERSION, "tables": list(TABLES)}, f"{path}/artifact")
    if trace is not None:
        trace.write.mode("overwrite").parquet(f"{path}/trace")
        write_jsonl(redacted(trace), f"{path}/trace_replay")


def open_documents(spark: SparkSession, path: str) -> dict[str, Any]:
    """The documents of a published run that it has, by name."""
    out = {}
    for name in DOCUMENTS:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            out[name] = read_document(spark, f"{path}/{name}")
    return out


def append_signals(spark: SparkSession, signals: DataFrame, path: str, keep: bool = True) -> None:
    """Prompt-repair signals: those of an ingest run replace the last ones, those of questions are added."""
    signals.write.mode("append" if keep else "overwrite").json(path)


def open_corpus(spark: SparkSession, path: str, **more) -> Corpus:
    """A published run, opened for questions."""
    fields = [FieldSpec(**{k: tuple(v) if isinstance(v, list) else v for k, v in f.items()}) for f in read_document(spark, f"{path}/catalog")]
    return Corpus(spark.read.parquet(f"{path}/silver_calls"), spark.read.parquet(f"{path}/chunks"), Catalog.of(*fields), **more)


def append_feedback(path: str, answer: dict[str, Any], spark: SparkSession) -> bool:
    """Appends an answer's requests and judgement where there is something to learn from; whether it did."""
    if not answer["column_requests"] and not answer["judgement"]["needs_cu_feedback"]:
        return False
    row = {"query": answer["query"], "column_requests": [asdict(r) for r in answer["column_requests"]], "judgement": {k: v for k, v in answer["judgement"].items() if k != "missing_field_requests"}}
    spark.createDataFrame([(json.dumps(row, ensure_ascii=False, sort_keys=True),)], "value string").write.mode("append").text(path)
    return True


REQUEST = "struct<action:string,field_name:string,field_type:string,description:string,reason:string,priority:string,suggested_allowed_values:array<string>,example_queries:array<string>,evidence_refs:array<string>>"


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, request columns) of every request; a line that is no JSON is an error."""
    schema = f"query string, column_requests array<{REQUEST}>, judgement struct<answerable:boolean,evidence_sufficient:boolean,success:boolean,needs_cu_feedback:boolean,confidence:string,failure_modes:array<string>>"
    rows = numbered(spark.read.schema(schema).option("mode", "FAILFAST").json(path))
    return rows.select("ordinal", F.explode("column_requests").alias("r")).select("ordinal", "r.*")
