"""What a published run promises: digests, the manifest's records, the extraction and platform contracts, and tasks to check it by."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.chunking import MAX_CHARS
from siltstone.operators.silver import LEAST_COVERAGE, SCHEMA_VERSION
from siltstone.operators.validation import response_schema
from siltstone.schemas import NOT_MENTIONED, Catalog, FieldSpec

EXTRACTION_PROMPT = "For every field give the value that the call's chunks bear out, with the refs of those chunks, or abstain. Use allowed values only."


def dataset_digest(rows: DataFrame, key: str, digits: int = 12) -> str:
    """A digest of all rows that doesn't hang on their order or partitions: rows are hashed as JSON with their key, and the hashes summed in four
    32-bit lanes, so that no row but four numbers reaches the driver."""
    told = F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.to_json(F.struct(*sorted(rows.columns)))), 256)
    lane = lambda k: F.sum(F.conv(F.substring(told, 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")).alias(f"l{k}")
    sums = rows.agg(F.count(F.lit(1)).alias("n"), *map(lane, range(4))).first()
    return hashlib.sha256("|".join(str(v) for v in sums).encode()).hexdigest()[:digits]


def manifest_records(calls: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per call its envelope and the ids of its chunks in order."""
    ids = chunks.groupBy("call_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id"))), lambda c: c["chunk_id"]).alias("chunk_ids"))
    keep = [c for c in ("call_id", "ordinal", "customer_id", "account_name", "date") if c in calls.columns]
    return calls.select(*keep).join(ids, "call_id", "left").withColumn("chunk_ids", F.coalesce("chunk_ids", F.array().cast("array<string>")))


def extraction_contract(specs: list[FieldSpec]) -> dict[str, Any]:
    """What any extractor must keep to, with a digest of it all."""
    body = {
        "schema_version": SCHEMA_VERSION,
        "prompt": {"text": EXTRACTION_PROMPT, "prompt_hash": hashlib.sha256(EXTRACTION_PROMPT.encode()).hexdigest()[:16]},
        "response_schema": response_schema(specs),
        "chunking": {"method": "greedy by turns", "max_chars": MAX_CHARS},
        "aggregation": {"empty_values": ["", NOT_MENTIONED], "lists": "exploded", "promotion": {"least_coverage": LEAST_COVERAGE}},
    }
    return body | {"contract_hash": hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()[:16]}


def platform_contract(specs: list[FieldSpec]) -> dict[str, Any]:
    """Tables, their key columns and types as a warehouse would create them, and what may be asked of them in SQL."""
    kinds = {"list": "ARRAY<STRING>", "boolean": "BOOLEAN"}
    silver = {"call_id": "STRING", "account_name": "STRING", "date": "STRING", **{s.name: kinds.get(s.type, "STRING") for s in specs}, "evidence_refs": "MAP<STRING,ARRAY<STRING>>", "quality_flags": "ARRAY<STRING>", "schema_version": "STRING"}
    return {
        "tables": {"silver_calls": {"key": ["call_id"], "columns": silver}, "chunks": {"key": ["chunk_id"], "columns": {"chunk_id": "STRING", "call_id": "STRING", "chunk_index": "INT", "text": "STRING", "snippet": "STRING"}}, "field_extractions": {"key": ["call_id", "field_name"], "columns": {"call_id": "STRING", "field_name": "STRING", "evidence_refs": "ARRAY<STRING>"}}},
        "tools": {"run_sql": {"statement": "one SELECT over the tables above", "writes": False}},
    }


def evaluation_tasks(silver: DataFrame, catalog: Catalog, most: int = 6, most_ids: int = 50) -> list[dict[str, Any]]:
    """Questions that the data itself answers: for the first value of each filterable field that occurs, the calls that have it (the first ``most_ids`` by ordinal), and
    for each field that can be counted, a count. Of every field one value's ids come to the driver."""
    out: list[dict[str, Any]] = []
    order = "ordinal" if "ordinal" in silver.columns else "call_id"
    for s in catalog.fields.values():
        if len(out) >= most:
            break
        label, c = s.name.replace("_", " "), F.col(s.name)
        hit = {"boolean": c, "list": F.size(c) > 0}.get(s.type, (c != NOT_MENTIONED) & (c != ""))
        first = silver.where(F.coalesce(hit, F.lit(False))).orderBy(order).select(s.name).first() if s.filterable else None
        if first:
            value = first[0][0] if s.type == "list" else first[0]
            same = F.array_contains(c, value) if s.type == "list" else c == F.lit(value)
            ids = [r["call_id"] for r in silver.where(same).orderBy(order).select("call_id").limit(most_ids).collect()]
            out.append({"query": f"Which calls have {label} {str(value).replace('_', ' ')}?", "expected_operation": "filter", "filters": {s.name: value}, "expected_call_ids": ids})
        if s.aggregatable and len(out) < most:
            out.append({"query": f"How many calls by {label}?", "expected_operation": "aggregate", "group_by": s.name, "expected_call_ids": []})
    return out[:most]
