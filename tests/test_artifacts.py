import json

import pytest

from siltstone.operators import chunking, feedback, tasks, validation
from siltstone.operators import silver as sv
from siltstone.plans.agent import Agent
from siltstone.schemas import FieldSpec
from siltstone.sources import sinks

SPECS = [FieldSpec("risk", "enum", allowed_values=("not_mentioned", "high")), FieldSpec("tags", "list", allowed_values=("a", "b")), FieldSpec("flag", "boolean"), FieldSpec("note", "string")]


def test_validation():
    item = lambda n, v, **k: {"name": n, "value": v, "confidence": "high", "evidence_refs": ["chunk:1"], "abstained": False, "rationale": "r"} | k
    got = {r["field_name"]: r for r in validation.validate(SPECS, {"fields": [item("risk", "extreme"), item("tags", ["a", "a", "x", 3]), item("flag", "TRUE", evidence_refs=["chunk:9"]), item("nope", 1)]}, {"chunk:1"})}
    assert got["risk"]["value"] == "not_mentioned" and got["risk"]["validation_errors"] == ["value_not_allowed:extreme"]
    assert got["tags"]["value"] == ["a"] and got["tags"]["validation_errors"] == ["value_not_allowed:x", "list_item_not_string"]
    assert got["flag"]["value"] is True and got["flag"]["validation_errors"] == ["invalid_evidence_refs", "missing_evidence_refs"]
    assert got["note"]["validation_errors"] == ["model:missing_field"] and got["note"]["abstained"]
    odd = validation.validate_item(SPECS[3], {"value": 5, "evidence_refs": "x", "confidence": "sure"}, set(), "m")
    assert odd["value"] == "5" and odd["validation_errors"] == ["expected_string", "evidence_refs_not_list", "missing_evidence_refs", "invalid_confidence"]
    assert validation.parse_object('sure: {"a": 1} ok') == {"a": 1}
    for bad in ("[1]", "none"):
        with pytest.raises(ValueError):
            validation.parse_object(bad)
    assert validation.response_schema(SPECS)["required"] == ["fields"]


def test_run_publish_open_ask_and_learn(spark, tmp_path):
    calls = spark.createDataFrame([("call-1", 0, "Acme", "Refund please, shipping delay.", [(1, "c", "Refund please, shipping delay.")]), ("call-2", 1, "Beta", "Founder led sales work.", [(1, "c", "Founder led sales work.")])], "call_id string, ordinal long, account_name string, transcript string, turns array<struct<turn_index:int,speaker:string,text:string>>")
    chunks = chunking.pack(calls)

    def client(request):
        if request["call_id"] == "call-2":
            raise TimeoutError
        return json.dumps({"fields": [{"name": "flag", "value": True, "confidence": "high", "evidence_refs": ["chunk:call-1:chunk-001"], "abstained": False, "rationale": "r"}]})

    rows = {(r["call_id"], r["field_name"]): r for r in validation.extract_with(client, SPECS, calls, chunks).collect()}
    assert rows["call-1", "flag"]["value_bool"] and rows["call-2", "flag"]["validation_errors"] == ["model:request_failed:TimeoutError"] and len(rows) == 8
    got = sv.extract(calls, chunks)
    report = sv.quality(got, calls)
    catalog = sv.catalog_of(sv.builtin_specs(), report)
    root = str(tmp_path / "run")
    sinks.publish(root, catalog, chunks, got, sv.pivot(calls, got, list(catalog.fields.values())), report, chunks.select("chunk_id", "text"))
    assert "Refund" not in spark.read.text(f"{root}/trace_replay").collect()[0][0]
    corpus = sinks.open_corpus(spark, root)
    assert corpus.catalog == catalog
    answer = Agent(corpus).answer("founder led")
    assert sinks.append_feedback(str(tmp_path / "fb"), answer, spark)
    merged = feedback.merge_requests(sinks.read_feedback(spark, str(tmp_path / "fb"))).collect()
    assert merged[0]["field_name"] == "founder_led" and merged[0]["priority"] == "high"


def test_tasks(spark):
    assert len(tasks.load_records('{"query": "a"}\n{"query": "b"}')) == len(tasks.load_records('{"tasks": ["a", {"query": "b"}]}')) == 2
    t = tasks.normalized(spark.createDataFrame([("How  many?", "x"), ("how many?", "curated"), ("", "curated"), ("Other", None)], "query string, source_type string").coalesce(1))
    assert sorted((r["query"], r["source_type"]) for r in t.collect()) == [("How many?", "manual"), ("Other", "manual")]
    assert tasks.source_counts(t).collect()[0]["count"] == 2
    r = tasks.pass_rate(spark.createDataFrame([("a", ["1"], ["1", "2"]), ("b", ["3"], None), ("c", None, [])], "task_id string, expected_call_ids array<string>, call_ids array<string>")).first()
    assert (r["tasks"], r["passed"], r["pass_rate"]) == (3, 2, 0.6667)
    hits = spark.createDataFrame([("x", 1.0), ("y", 0.5)], "chunk_id string, score double")
    assert [(h["chunk_id"], h["relevance"]) for h in tasks.rerank(hits, [{"chunk_id": "y", "relevance": 7}, {"chunk_id": "z"}, {"chunk_id": "y"}, {"chunk_id": "x", "relevance": "bad"}]).collect()] == [("y", 1.0), ("x", 0.0)]
    with pytest.raises(ValueError):
        tasks.rerank(hits, [])
    s = lambda *rows: spark.createDataFrame(rows, "task_id string, success boolean, used_filter boolean")
    r = tasks.loop_summary(s(("a", False, False), ("b", True, False)), s(("a", True, True), ("b", True, False))).first()
    assert (r["success_delta"], r["filter_delta"]) == (1, 1)
