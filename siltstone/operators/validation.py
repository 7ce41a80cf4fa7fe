"""Validation of model payloads. Plain functions, safe to ship to executors; ``extract_with`` runs them there.

A payload is {"fields": [{name, value, confidence, evidence_refs, abstained, rationale}]}. Every spec
yields one row whatever the payload holds; what is wrong is coerced and named in ``validation_errors``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.schemas import NOT_MENTIONED, FieldSpec

CONFIDENCE = ("low", "medium", "high")
ROW = "call_id string, field_name string, field_type string, value_str string, value_list array<string>, value_bool boolean, confidence string, evidence_refs array<string>, abstained boolean, rationale string, validation_errors array<string>"


# The codes that validation_errors are made of.
NOT_BOOLEAN, NOT_STRING_ITEM, NOT_ALLOWED, NOT_STRING = "expected_boolean", "list_item_not_string", "value_not_allowed:{}", "expected_string"
REFS_NOT_LIST, BAD_REFS, NO_REFS = "evidence_refs_not_list", "invalid_evidence_refs", "missing_evidence_refs"
BAD_ABSTAINED, BAD_CONFIDENCE, BAD_RATIONALE, MISSING_FIELD = "abstained_not_boolean", "invalid_confidence", "invalid_rationale", "missing_field"


def default_value(spec: FieldSpec) -> Any:
    by_type = {"list": [], "boolean": False, "enum": NOT_MENTIONED if NOT_MENTIONED in spec.allowed_values or not spec.allowed_values else spec.allowed_values[0]}
    return by_type.get(spec.type, NOT_MENTIONED)


def coerce(spec: FieldSpec, value: Any) -> tuple[Any, list[str]]:
    """The value in the spec's type, and what had to be corrected. A lone value of a list field is a list of one."""
    nothing = value is None or value == ""
    match spec.type:
        case "boolean":
            told = {"true": True, "false": False}.get(value.lower()) if isinstance(value, str) else value
            return (told, []) if isinstance(told, bool) else (False, [NOT_BOOLEAN])
        case "list":
            items = value if isinstance(value, list) else [] if nothing or value == NOT_MENTIONED else [value]
            fault = lambda v: NOT_STRING_ITEM if not isinstance(v, str) else NOT_ALLOWED.format(v) if spec.allowed_values and v not in spec.allowed_values else None
            faults = [fault(v) for v in items]
            return list(dict.fromkeys(v for v, f in zip(items, faults) if f is None)), [f for f in faults if f]
        case "enum":
            known = isinstance(value, str) and value in spec.allowed_values
            return (value, []) if known else (default_value(spec), [NOT_ALLOWED.format(value)])
        case _:
            return (default_value(spec), []) if nothing else (value, []) if isinstance(value, str) else (str(value), [NOT_STRING])


def is_empty(value: Any) -> bool:
    return value is False or value is None or value in ("", [], NOT_MENTIONED)


def checked_refs(refs: Any, known: set[str]) -> tuple[list[str], list[str]]:
    """The refs that were shown, in order, and what is wrong with the rest."""
    if refs is None:
        return [], []
    if not isinstance(refs, list):
        return [], [REFS_NOT_LIST]
    good = [r for r in refs if isinstance(r, str) and r in known]
    return good, [BAD_REFS] if len(good) < len(refs) else []


def validate_item(spec: FieldSpec, item: dict[str, Any], known: set[str], extractor: str) -> dict[str, Any]:
    """A row from one item. What the item leaves out takes its default without an error: low confidence, no
    rationale, and abstained where the value is empty."""
    value, errors = coerce(spec, item.get("value"))
    refs, bad = checked_refs(item.get("evidence_refs"), known)
    given = {"abstained": item.get("abstained", is_empty(value)), "confidence": item.get("confidence", CONFIDENCE[0]), "rationale": item.get("rationale", "")}
    errors += bad
    if not isinstance(given["abstained"], bool):
        errors.append(BAD_ABSTAINED)
        given["abstained"] = is_empty(value)
    if not (refs or given["abstained"]):
        errors.append(NO_REFS)
    if not isinstance(given["confidence"], str) or given["confidence"] not in CONFIDENCE:
        errors.append(BAD_CONFIDENCE)
        given["confidence"] = CONFIDENCE[0]
    if not isinstance(given["rationale"], str):
        errors.append(BAD_RATIONALE)
        given["rationale"] = ""
    said = "; ".join(x for x in (f"validated:{extractor}", given["rationale"]) if x)
    return {"field_name": spec.name, "value": value, **given, "rationale": said, "evidence_refs": refs, "validation_errors": errors}


def validate(specs: list[FieldSpec], payload: Any, known_refs: set[str], extractor: str = "model") -> list[dict[str, Any]]:
    """One row per spec, whatever the payload holds. Of repeated items the last counts; unknown names, and items without a name, are left
    out; a missing one gets its default and abstains."""
    items = payload.get("fields") if isinstance(payload, dict) else None
    by_name = {i["name"]: i for i in (items if isinstance(items, list) else ()) if isinstance(i, dict) and isinstance(i.get("name"), str)}
    missing = lambda s: {"field_name": s.name, "value": default_value(s), "confidence": CONFIDENCE[0], "evidence_refs": [], "abstained": True, "rationale": "defaulted by extraction validator", "validation_errors": [f"{extractor}:{MISSING_FIELD}"]}
    return [validate_item(s, by_name[s.name], known_refs, extractor) if s.name in by_name else missing(s) for s in specs]


def parse_object(text: str) -> dict[str, Any]:
    """A JSON object: the whole text, else from the first { to the last }."""
    try:
        got = json.loads(text)
    except ValueError:
        lo, hi = text.find("{"), text.rfind("}")
        if lo < 0 or hi < lo:
            raise ValueError("no JSON object in the text") from None
        got = json.loads(text[lo : hi + 1])
    if not isinstance(got, dict):
        raise ValueError("not a JSON object")
    return got


def response_schema(specs: list[FieldSpec]) -> dict[str, Any]:
    """JSON schema that a payload for these specs must meet."""
    kinds = {"boolean": {"type": "boolean"}, "string": {"type": "string"}}

    def value(s: FieldSpec) -> dict[str, Any]:
        one = {"type": "string", "enum": list(s.allowed_values)} if s.allowed_values else {"type": "string"}
        return {"type": "array", "items": one} if s.type == "list" else one if s.type == "enum" else kinds[s.type]

    item = lambda s: {"type": "object", "additionalProperties": False, "required": ["name", "value", "confidence", "evidence_refs", "abstained", "rationale"], "properties": {"name": {"const": s.name}, "value": value(s), "confidence": {"enum": list(CONFIDENCE)}, "evidence_refs": {"type": "array", "items": {"type": "string"}}, "abstained": {"type": "boolean"}, "rationale": {"type": "string"}}}
    return {"type": "object", "additionalProperties": False, "required": ["fields"], "properties": {"fields": {"type": "array", "items": {"anyOf": [item(s) for s in specs]}}}}


def extract_with(client: Callable[[dict[str, Any]], str], specs: list[FieldSpec], calls: DataFrame, chunks: DataFrame, extractor: str = "model", fallback: DataFrame | None = None) -> DataFrame:
    """Asks ``client`` once per call, on the executors, and validates what it returns. A call whose request fails, or whose answer holds no
    list of fields, gets the rows that ``fallback`` (extractions of the rules) has for it, tagged ``llm_fallback:`` and the fault, else default rows
    that say so; Spark's retries are for lost executors only. Rows come call by call, in the calls' ``ordinal`` where they have one, in the specs' order."""
    each = chunks.groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "text"))).alias("chunks"))
    keep = [c for c in ("call_id", "ordinal", "customer_id", "account_name", "date") if c in calls.columns]
    src = calls.select(*keep).join(each, "call_id", "left")
    if fallback is not None:
        parts = [c for c in FALLBACK if c in fallback.columns]
        src = src.join(fallback.groupBy("call_id").agg(F.collect_list(F.struct(*parts)).alias("ruled")), "call_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                shown = r["chunks"] or []
                known = {f"chunk:{c['chunk_id']}" for c in shown}
                request = {"call": {k: r[k] for k in keep if k != "ordinal"}, "call_id": r["call_id"], "fields": [s.name for s in specs], "chunks": shown}
                ruled = {}
                try:
                    payload = parse_object(client(request))
                    if not isinstance(payload.get("fields"), list):
                        raise ValueError("no list of fields")
                    got = validate(specs, payload, known, extractor)
                except Exception as e:  # noqa: BLE001  any fault of a client is a row, not a failed job
                    got, fault = validate(specs, None, known, extractor), type(e).__name__
                    for g in got:
                        g["validation_errors"] = [f"{extractor}:request_failed:{fault}"]
                    ruled = {x["field_name"]: x | {"rationale": f"llm_fallback:{fault}", "validation_errors": [f"llm_fallback:{fault}"]} for x in r.get("ruled") or []}
                for s, g in zip(specs, got):
                    v = g.pop("value")
                    own = {"value_str": v if isinstance(v, str) else None, "value_list": v if isinstance(v, list) else None, "value_bool": v if isinstance(v, bool) else None}
                    rows.append({"call_id": r["call_id"], **g, **own, **ruled.get(s.name, {}), "field_type": s.type})
            yield pa.RecordBatch.from_pylist([{f: x.get(f) for f in _ARROW.names} for x in rows], schema=_ARROW)

    out = src.mapInArrow(run, ROW)
    return out if "ordinal" not in keep else out.join(calls.select("call_id", F.col("ordinal").alias("call_ordinal")), "call_id").orderBy("call_ordinal", F.array_position(F.array(*[F.lit(s.name) for s in specs]), F.col("field_name"))).drop("call_ordinal")


#: What a fallback's rows may tell.
FALLBACK = ("field_name", "value_str", "value_list", "value_bool", "confidence", "evidence_refs", "abstained")
_ARROW = pa.schema([("call_id", pa.string()), ("field_name", pa.string()), ("field_type", pa.string()), ("value_str", pa.string()), ("value_list", pa.list_(pa.string())), ("value_bool", pa.bool_()), ("confidence", pa.string()), ("evidence_refs", pa.list_(pa.string())), ("abstained", pa.bool_()), ("rationale", pa.string()), ("validation_errors", pa.list_(pa.string()))])
