import json

import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as tx
from siltstone.operators import aggregates, chunking, feedback, filters, inference, retrieval
from siltstone.operators import silver as sv
from siltstone.plans import views
from siltstone.schemas import Catalog, FieldSpec, validate_specs
from siltstone.sources import calls as src

CATALOG = Catalog.of(FieldSpec("product_area", "enum", allowed_values=("crm", "analytics")), FieldSpec("security_review_requested", "boolean"), FieldSpec("deal_size", "string"), FieldSpec("hidden", "string", aggregatable=False, filterable=False))


@pytest.fixture(scope="module")
def silver(spark):
    rows = [(1, "call-001", "Acme", "2026-01-01", "crm", True, 2500.0, {"product_area": ["chunk:call-001:chunk-001"]}), (2, "call-002", "Beta", "2026-01-02", "crm", False, 800.0, {"product_area": ["chunk:call-002:chunk-001"]}), (3, "call-003", "Core", "2026-02-01", "analytics", True, 9000.0, {"product_area": ["chunk:call-003:chunk-001"]})]
    return spark.createDataFrame(rows, "ordinal long, call_id string, account_name string, date string, product_area string, security_review_requested boolean, deal_size double, evidence_refs map<string,array<string>>")


def run(silver, expression):
    return [tuple(r) for r in aggregates.evaluate(expression, silver, CATALOG).frame.collect()]


def test_expressions(silver):
    assert run(silver, "ratio(count_if(records, 'security_review_requested', True), count(records))") == [(2, 3, 0.6667)]
    assert run(silver, "top_k(records, 'product_area', k=1)") == [("crm", 2)]
    assert run(silver, "numeric_range_count(records, 'deal_size', min_value=1000, max_value=5000)")[0][0] == 1
    assert run(silver, "cohort_count(records, 'month')") == [("2026-01", 2), ("2026-02", 1)]
    assert run(silver, "date_range_count(records, start='2026-01-02')")[0] == (2, "2026-01-02", None, ["call-002", "call-003"])
    assert run(silver, "count_where(records, 'deal_size', '>=', 2500)") == [(2,)]
    assert run(silver, "nested_group_count(records, ['product_area', 'security_review_requested'])") == [("analytics", "True", 1), ("crm", "True", 1)]
    assert run(silver, "count(group_count(records, 'product_area'))") == [(2,)]
    assert run(silver, "[count(records), count_if(records, 'product_area', 'crm')]") == [([3.0, 2.0],)]
    assert run(silver, "ratio(count_if(records, 'product_area', 'none'), 0)") == [(0, 0, None)]


@pytest.mark.parametrize("bad", ["__import__('os').system('true')", "records.x", "count(records) + 1", "group_count(records, 'nope')", "group_count(records, 'hidden')", "open('x')", "count(", "[x for x in records]", "cohort_count(records, 'week')", "top_k(records, 'product_area', 1, 2)"])
def test_bad_expressions(silver, bad):
    with pytest.raises(ValueError):
        aggregates.evaluate(bad, silver, CATALOG).frame.collect()


def test_one_scan_per_expression(silver):
    plan = aggregates.evaluate("ratio(count_if(records, 'product_area', 'crm'), count(records))", silver, CATALOG).frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1


def test_evidence(silver):
    assert [r["ref"] for r in aggregates.evidence_refs(silver, ["product_area"], 2).collect()] == ["chunk:call-001:chunk-001", "chunk:call-002:chunk-001"]


def test_filters(silver):
    ids = lambda f, n=None: [r["call_id"] for r in filters.query_silver(silver, filters.validate_filters(f, CATALOG), n).orderBy("ordinal").collect()]
    assert ids({"product_area": "crm"}) == ["call-001", "call-002"]
    assert ids({"security_review_requested": "true", "product_area": None}) == ["call-001", "call-003"]
    assert ids({}, 2) == ["call-001", "call-002"]
    for bad in ({"nope": 1}, {"hidden": "x"}, {"product_area": "sales"}, {"security_review_requested": "maybe"}):
        with pytest.raises(ValueError):
            filters.validate_filters(bad, CATALOG)


def test_null_elements_and_missing(spark):
    df = spark.createDataFrame([(1, ["a", None], None), (2, None, "x"), (3, [], "")], "ordinal int, l array<string>, s string")
    assert [r[0] for r in df.where(filters.matches(df, "l", "b")).collect()] == []
    assert [r[0] for r in df.where(filters.matches(df, "l", ["a", "z"])).collect()] == [1]
    assert [r[0] for r in df.where(filters.matches(df, "s", None)).collect()] == [1]
    assert [tuple(r) for r in aggregates.group_count(df, "l").collect()] == [("a", 1)]


def test_typed_comparison(spark):
    df = spark.createDataFrame([("10",), ("9",), ("x",), (None,), ("1d",), ("nan",)], "v string")
    n = lambda op, e: df.where(filters.compared(df, "v", op, e)).count()
    assert (n(">", 9), n("==", 10), n("!=", 10), n("==", "x"), n("<", "x")) == (1, 1, 5, 1, 0)


def test_text(spark):
    one = lambda c, t: spark.createDataFrame([(t,)], "t string").select(c).first()[0]
    assert one(tx.english_tokens("t"), "The customer's Founder-led call_flow, a B2B x") == ["customer", "founder", "led", "flow", "b2b"]
    assert one(tx.normalize_label("t"), " Hello,  World! ") == "hello_world"
    assert one(tx.normalize_identifier("t"), "2nd try") == "field_2nd_try"
    assert one(tx.snippet("t"), "a " * 300).endswith("...") and len(one(tx.snippet("t"), "a " * 300)) <= 220
    assert one(tx.parse_date("t"), "2026-02-30x") is None and str(one(tx.parse_date("t"), "2026-02-03T10")) == "2026-02-03"
    assert one(tx.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))), "") == 0


def test_packing(spark):
    turns = [(i + 1, "s", "x" * n) for i, n in enumerate((1000, 10, 890, 1, 900))]
    df = spark.createDataFrame([("c", 1, turns), ("e", 2, [])], "call_id string, ordinal long, turns array<struct<turn_index:int,speaker:string,text:string>>")
    got = [(r["chunk_id"], r["turn_start"], r["turn_end"]) for r in chunking.pack(df).orderBy("chunk_id").collect()]
    assert got == [("c:chunk-001", 1, 1), ("c:chunk-002", 2, 3), ("c:chunk-003", 4, 4), ("c:chunk-004", 5, 5)]


def test_read_calls(spark, tmp_path):
    rows = [{"calllog_id": "call-1", "client_id": "c", "contact_detail": "Acme", "call_event_date": "2026-05-01", "calllog_result": [{"speaker": 1, "best_text": "We need SSO"}, {"speaker": 2, "best_text": " "}, {"speaker": 2, "best_text": "Pricing is blocking renewal."}]}]
    (tmp_path / "calls.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    r = src.read_calls(spark, str(tmp_path / "calls.jsonl")).first()
    assert (r["call_id"], r["customer_id"], r["account_name"], r["date"]) == ("call-1", "c", "Acme", "2026-05-01")
    assert [(t["turn_index"], t["speaker"]) for t in r["turns"]] == [(1, "1"), (3, "2")]
    (tmp_path / "calls.csv").write_text('id,transcript\n0,"hello\n\nthere"\n')
    assert spark.read.option("header", True).option("multiLine", True).csv(str(tmp_path / "calls.csv")).count() == 1
    r = src.normalize_calls(spark.createDataFrame([(0, 7, "hello\n\nthere")], "id int, ordinal long, transcript string")).first()
    assert r["call_id"] == "0" and [t["text"] for t in r["turns"]] == ["hello", "there"]
    as_json = spark.createDataFrame([("a", 1, '[{"speaker":"x","text":"hi"},"raw"]'), ("b", 2, "plain"), ("c", 3, '{"best_text":"one"}')], "call_id string, ordinal long, calllog_result string")
    assert {r["call_id"]: len(r["turns"]) for r in src.normalize_calls(as_json).collect()} == {"a": 2, "b": 1, "c": 1}
    with pytest.raises(ValueError):
        src.read_calls(spark, "x.xml")


def test_bm25(spark):
    docs = spark.createDataFrame([("a", "the and call"), ("b", "founder led sales calls"), ("c", "")], "chunk_id string, bm25_text string")
    q = spark.createDataFrame([(0, "the call"), (1, "founder sales")], "query_id int, query string")
    got = retrieval.bm25(docs, q).collect()
    assert [(r["query_id"], r["chunk_id"], r["matched_terms"]) for r in got] == [(1, "b", ["founder", "sales"])]
    assert retrieval.corpus_stats(docs).first()["n"] == 3


def test_diverse():
    assert retrieval.diverse(["founder led sales", "Sales founder led!", "pricing"]) == ["founder led sales", "pricing"]


def test_builtin_extraction_and_gate(spark):
    said = {"call-001": "We need SSO and audit logs for security review.", "call-002": "Pricing is blocking renewal; shipping delay and coupon codes and refund.", "call-003": "hello there"}
    calls = spark.createDataFrame([(k, i, t, [(1, "customer", t)]) for i, (k, t) in enumerate(said.items())], "call_id string, ordinal long, transcript string, turns array<struct<turn_index:int,speaker:string,text:string>>")
    got = sv.extract(calls, chunking.pack(calls)).cache()
    at = {(r["call_id"], r["field_name"]): r for r in got.collect()}
    assert len(at) == 3 * len(sv.FIELD_ORDER)
    assert at["call-001", "security_review_requested"]["value_bool"] and not at["call-002", "security_review_requested"]["value_bool"]
    assert at["call-002", "renewal_risk"]["value_str"] == "pricing_pushback"
    assert at["call-002", "complaint_theme"]["value_list"] == ["shipping_delay", "coupon_confusion", "refund_policy"]
    assert at["call-001", "urgency"]["value_str"] == "medium" and at["call-003", "urgency"]["abstained"]
    assert at["call-001", "next_action"]["evidence_refs"] == ["chunk:call-001:chunk-001"]
    report = sv.quality(got, calls)
    q = {r["field_name"]: (r["support_call_count"], r["fill_rate"], r["evidence_coverage"], r["status"]) for r in report.collect()}
    assert q["complaint_theme"] == (1, 0.3333, 1.0, "promote") and q["data_gap"][3] == "hold"
    catalog = sv.catalog_of(sv.builtin_specs(), report)
    wide = sv.pivot(calls, got, list(catalog.fields.values())).orderBy("ordinal").collect()
    assert [r["call_id"] for r in wide] == list(said) and wide[1]["complaint_theme"][0] == "shipping_delay"


def test_feedback(spark):
    rows = [(1, "Founder Led", "add_allowed_values", "enum", "low", "short", ["a", "b"]), (2, "founder_led", "add_field", "list", "high", "a longer text", ["b", "c"]), (3, "other", "add_field", "list", "medium", "x", None)]
    got = feedback.merge_requests(spark.createDataFrame(rows, "ordinal int, field_name string, action string, field_type string, priority string, description string, suggested_allowed_values array<string>")).collect()
    assert [(r["field_name"], r["priority"], r["action"], r["field_type"], r["description"], r["suggested_allowed_values"], r["count"]) for r in got][0] == ("founder_led", "high", "add_field", "list", "a longer text", ["a", "b", "c"], 2)
    df = spark.createDataFrame([((1, "secret", ""), [("x", "keep")])], "a struct<id:int,text:string,snippet:string>, b array<struct<snippet:string,id:string>>")
    r = feedback.redacted(df).first()
    assert (r["a"]["text"], r["a"]["snippet"], r["a"]["id"], r["b"][0]["snippet"], r["b"][0]["id"]) == ("[redacted]", "", 1, "[redacted]", "keep")


def test_specs_and_inference(spark):
    assert validate_specs([{"name": "Risk!", "type": "enum", "allowed_values": ["High"]}])[0].allowed_values == ("not_mentioned", "high")
    for bad in ([], [{"name": "call_id", "type": "string"}], [{"name": "x", "type": "map"}], [{"name": "x", "type": "list"}]):
        with pytest.raises(ValueError):
            validate_specs(bad)
    chunks = spark.createDataFrame([(1, "We need the Salesforce export. Salesforce export fails.")], "ordinal int, text string")
    assert [r["label"] for r in inference.top_labels(chunks, 2).collect()] == ["salesforce", "export"]
    assert {r["label"]: r["score"] for r in inference.system_mentions(chunks).collect()}["salesforce"] == 6
    assert any(s.name == "need" for s in inference.infer(chunks))


def test_followers_across_blocks(spark):
    """A group of most rows, gaps of whole blocks, a null group and a lone row, against a sort."""
    rows = [(g, k, f"v{k}") for k in range(0, 3000, 7) for g in ("a",)] + [("b", k, f"b{k}") for k in (5, 9_000, 9_001, 70_000)] + [(None, k, f"n{k}") for k in (1, 250)] + [("c", 3, "lone")]
    got = {(r["lang"], r["ordinal"]): r["next"] for r in views.followers(spark.createDataFrame(rows, "lang string, ordinal long, id string"), "lang", "id", block=100).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        own = sorted((k, v) for x, k, v in rows if x == g)
        want |= {(g, k): n for (k, _), n in zip(own, [*(v for _, v in own[1:]), None])}
    assert got == want
    assert views.followers(spark.createDataFrame([], "lang string, ordinal long, id string"), "lang", "id").collect() == []
