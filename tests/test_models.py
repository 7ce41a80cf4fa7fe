"""Models and their fallbacks, contracts, the loop, negotiation, feedback reports and small sources."""

import json

import pytest
from pyspark.sql import functions as F

from siltstone.operators import chunking, feedback, negotiation, retrieval, tasks
from siltstone.operators import silver as sv
from siltstone.operators import validation as va
from siltstone.plans import contracts, loop, model, usage
from siltstone.plans import planner as pl
from siltstone.plans.agent import Agent, Corpus, State
from siltstone.schemas import Catalog, FieldSpec
from siltstone.sources import calls as src
from siltstone.sources import extras, sinks

SAID = {"c1": "We need SSO and audit logs for the security review.", "c2": "Pricing is blocking renewal; a refund please.", "c3": "Founder led sales talk closes better."}
CALLS = "call_id string, ordinal long, account_name string, transcript string, turns array<struct<turn_index:int,speaker:string,text:string>>"


@pytest.fixture(scope="module")
def corpus(spark):
    made = spark.createDataFrame([(k, i, f"acc {k}", t, [(1, "customer", t)]) for i, (k, t) in enumerate(SAID.items())], CALLS)
    chunks, specs = chunking.pack(made).cache(), sv.builtin_specs()
    return Corpus(sv.pivot(made, sv.extract(made, chunks), specs).cache(), chunks, Catalog.of(*specs))


def test_generic_fields_are_extracted(spark):
    made = spark.createDataFrame([(k, i, "a", t, [(1, "customer", t)]) for i, (k, t) in enumerate(SAID.items())], CALLS)
    specs = [FieldSpec("sales_style", "list", allowed_values=("founder_led", "talk_sales", "cold_call")), FieldSpec("money", "enum", allowed_values=("not_mentioned", "refund", "pricing")), FieldSpec("audit_logs", "boolean"), FieldSpec("note", "string"), FieldSpec("urgency", "enum", allowed_values=("not_mentioned", "urgent")), FieldSpec("follow_up_action", "string")]
    got = {(r["call_id"], r["field_name"]): r for r in sv.extract(made, chunking.pack(made), sv.rows_for(specs)).collect()}
    assert got["c3", "sales_style"]["value_list"] == ["founder_led", "talk_sales"] and got["c3", "sales_style"]["confidence"] == "medium"
    assert got["c2", "money"]["value_str"] == "refund" and got["c1", "money"]["abstained"] and got["c1", "audit_logs"]["value_bool"]
    assert got["c1", "note"]["value_str"] == "not_mentioned" and got["c1", "urgency"]["value_str"] == "medium" and got["c2", "follow_up_action"]["value_str"].startswith("Pricing")


def test_validator_is_total():
    specs = [FieldSpec("a", "list", allowed_values=("x", "y")), FieldSpec("b", "enum", allowed_values=("p", "q")), FieldSpec("c", "boolean")]
    for payload in (None, 3, {"fields": 3}, {"fields": [3, {"name": [1]}, {}]}):
        assert [r["validation_errors"] for r in va.validate(specs, payload, set())] == [["model:missing_field"]] * 3
    got = va.validate(specs, {"fields": [{"name": "a", "value": "x", "evidence_refs": ["chunk:1", {}, "chunk:2"], "rationale": "said"}, {"name": "b", "value": None}, {"name": "c", "value": "TRUE", "confidence": [1], "abstained": "no"}]}, {"chunk:1"})
    assert got[0]["value"] == ["x"] and got[0]["evidence_refs"] == ["chunk:1"] and got[0]["validation_errors"] == ["invalid_evidence_refs"] and got[0]["rationale"] == "validated:model; said" and not got[0]["abstained"]
    assert got[1]["value"] == "p" and got[1]["validation_errors"] == ["value_not_allowed:None", "missing_evidence_refs"]
    assert got[2]["value"] is True and got[2]["validation_errors"] == ["abstained_not_boolean", "missing_evidence_refs", "invalid_confidence"]


def test_failed_requests_fall_back_to_rules(spark, corpus):
    specs = [s for s in sv.builtin_specs() if s.name in ("urgency", "renewal_risk")]
    made = spark.createDataFrame([(k, i, "a", t, [(1, "customer", t)]) for i, (k, t) in enumerate(SAID.items())], CALLS)
    ruled = sv.extract(made, corpus.chunks)

    def client(request):
        if request["call_id"] == "c2":
            raise RuntimeError("down")
        return json.dumps({"fields": [{"name": "urgency", "value": "high", "evidence_refs": [f"chunk:{request['chunks'][0]['chunk_id']}"]}]})

    got = va.extract_with(client, specs, made, corpus.chunks, fallback=ruled).collect()
    assert [(r["call_id"], r["field_name"]) for r in got] == [(k, s.name) for k in SAID for s in specs]
    at = {(r["call_id"], r["field_name"]): r for r in got}
    assert at["c1", "urgency"]["value_str"] == "high" and at["c1", "renewal_risk"]["validation_errors"] == ["model:missing_field"]
    assert at["c2", "renewal_risk"]["value_str"] == "pricing_pushback" and at["c2", "renewal_risk"]["validation_errors"] == ["llm_fallback:RuntimeError"]


def test_planner_and_judge_fall_back(corpus):
    def down(request):
        raise TimeoutError

    got = Agent(corpus, model.ModelPlanner(down), model.ModelJudge(down)).answer("Which calls mention pricing?")
    assert got["plan"].planner == "model->fallback:heuristic" and [r["call_id"] for r in got["records"]] == ["c2"] and got["judgement"]["judge"] == "model->fallback:heuristic"
    said = {"planner": {"operation": "filter", "filters": {"renewal_risk": "pricing_pushback"}}, "judge": {"answerable": True, "evidence_sufficient": False, "success": True, "confidence": "sure", "failure_modes": ["thin", " ", "thin"]}}
    got = Agent(corpus, model.ModelPlanner(lambda r: {"output_text": json.dumps(said[r["prompt_name"]])}), model.ModelJudge(lambda r: json.dumps(said[r["prompt_name"]]))).answer("anything")
    assert got["plan"].planner == "model" and got["judgement"]["confidence"] == "low" and got["judgement"]["failure_modes"] == ["thin"] and not got["judgement"]["evidence_sufficient"]
    assert model.NoopJudge().judge(got["plan"], State())["judge"] == "noop"
    assert model.response_text({"choices": [{"message": {"content": "hi"}}]}) == "hi" == model.response_text({"output": [{"content": [{"text": "h"}, {"text": "i"}]}]})
    with pytest.raises(ValueError):
        model.response_text({"choices": []})


def test_prompts_schema_and_tasks(corpus):
    p = model.PROMPTS["planner"]
    assert p.render(query="x {y}").endswith("x {y}") and p.metadata()["prompt_hash"] == model.prompt_state()["planner"]["prompt_hash"] and len(p.digest) == 16
    specs, by = model.induced(lambda r: json.dumps({"fields": [{"name": "Mood", "type": "enum", "allowed_values": ["good", "bad"]}]}), corpus.chunks)
    assert by == "model" and specs[0].allowed_values == ("not_mentioned", "good", "bad")
    specs, by = model.induced(lambda r: "no", corpus.chunks)
    assert by.endswith("heuristic") and specs
    with pytest.raises(ValueError):
        model.induced(lambda r: "no", corpus.chunks, strict=True)
    assert model.model_tasks(lambda r: '{"tasks": [{"query": "Why?", "expected_operation": "dance"}]}', corpus.catalog) == [{"query": "Why?", "expected_operation": None, "source_type": "llm_bootstrap"}]
    assert model.model_tasks(lambda r: "no", corpus.catalog) == tasks.bootstrap(corpus.catalog, 6)
    assert model.schema_snapshot(corpus.catalog)["schema_hash"] == model.schema_snapshot(corpus.catalog)["schema_hash"]
    assert model.compacted({"a": list(range(20)), "b": "x" * 900})["a"] == list(range(12, 20)) and len(model.compacted("x" * 900)) == 400


def test_retrieval_agent(spark, corpus):
    docs = corpus.chunks.select("chunk_id", F.col("text").alias("bm25_text"))
    look = lambda tool, query: retrieval.bm25(docs, spark.createDataFrame([(0, query)], "query_id int, query string"), 5)
    replies = iter(['{"tool": "bm25_search_chunks", "query": "pricing renewal"}', '{"tool": "bm25_search_chunks", "query": "Renewal pricing!"}'])
    got = model.RetrievalAgent(look, lambda r: next(replies)).run("founder led unheard")
    assert [c.query for c in got] == ["founder led unheard", "pricing renewal"] and got[0].missing == ["unheard"]
    forced = model.RetrievalAgent(look, least=2).run("founder unheard refund")
    assert [c.query for c in forced] == ["founder unheard refund", "unheard"]
    found = model.branches(model.RetrievalAgent(look), ["founder led", "Founder led", "pricing refund"], corpus.chunks)
    assert len(found) == 2 and model.joined(found) == ["c3:chunk-001", "c2:chunk-001"] and model.branch_id("t", "A  b") == model.branch_id("t", "a b")
    strange = lambda tool, query: spark.createDataFrame([("nope", ["x"])], "chunk_id string, matched_terms array<string>")
    with pytest.raises(ValueError, match="nope"):
        model.branches(model.RetrievalAgent(strange), ["x"], corpus.chunks)


def test_agentic_search_and_fetched_refs(corpus):
    plan = pl.Plan("search", query="founder unheard refund", steps=(pl.Step("search_chunks", {"query": "founder unheard refund", "mode": "agentic"}), pl.Step("fetch_chunks", {"refs": ["chunk:c1:chunk-001", "chunk:zz"]})))

    class Given:
        def plan(self, query, catalog):
            return plan

    got = Agent(corpus, Given()).answer(plan.query)
    assert [e["chunk_id"] for e in got["evidence"]] == ["c1:chunk-001"] and got["trace"][0]["result"] == "2 chunks for 2 queries"
    plan = pl.Plan("aggregate", group_by="complaint_theme", steps=(pl.Step("aggregate_silver", {"group_by": "complaint_theme"}), pl.Step("fetch_chunks")))
    assert [e["chunk_id"] for e in Agent(corpus, Given()).answer("x")["evidence"]] == ["c2:chunk-001"]


def test_usage_and_budget():
    u = usage.Usage(usage.prices_from("m=2/8, n=1"))
    u.saw("m", 1000, 100)
    mark = u.mark()
    u.saw("n", 10, 10)
    assert u.totals()["cost_usd"] == 0.00282 and u.since(mark) == {"calls": 1, "input_tokens": 10, "output_tokens": 10, "cost_usd": 0.00002}
    g = usage.BudgetGuard(max_usd=0.001, usage=u)
    assert g.stopped() and g.reason == "budget"
    free = usage.BudgetGuard(max_usd=1.0, usage=usage.Usage())
    free.usage.saw("x", 5, 5)
    with pytest.warns(UserWarning, match="without a price"):
        assert not free.stopped()
    assert usage.parse_usage({"usage": {"prompt_tokens": 3, "completion_tokens": 4}}) == (3, 4) and usage.parse_usage({}) == (0, 0)
    with pytest.raises(ValueError):
        usage.prices_from("m=x")


REQUESTS = "array<struct<action:string,field_name:string,field_type:string,description:string,reason:string,priority:string,suggested_allowed_values:array<string>,example_queries:array<string>,evidence_refs:array<string>>>"


def test_feedback_synthesis_and_report(spark):
    one = ("add_field", "Sales Style!", "list", "d", "r", "URGENT", ["Founder Led", "founder led"], ["q"], None)
    rows = [(1, "which calls", [one], None, None, True), (2, "founder led growth calls", [], [], ["no chunks"], False), (3, "expansion revenue", None, None, None, True), (4, "fine query", None, None, None, False)]
    got = feedback.normalized_requests(feedback.synthesized(spark.createDataFrame(rows, f"ordinal long, query string, column_requests {REQUESTS}, judge_requests {REQUESTS}, failures array<string>, needs_cu_feedback boolean")))
    at = {r["ordinal"]: r for r in got.collect()}
    assert {k: r["source"] for k, r in at.items()} == {1: "asked", 2: "search_failures", 3: "judgement"}
    assert (at[1]["field_name"], at[1]["priority"], at[1]["suggested_allowed_values"]) == ("sales_style", "medium", ["founder_led"]) and at[2]["field_name"] == "founder_led_growth" and at[2]["priority"] == "high"
    specs = spark.createDataFrame([("sales_style",)], "field_name string")
    quality = spark.createDataFrame([("sales_style", 0, 0.0, 0.0, "hold"), ("topic", 5, 0.5, 0.4, "hold"), ("fine", 5, 0.5, 1.0, "promote")], "field_name string, support_call_count long, fill_rate double, evidence_coverage double, status string")
    marked = {r["field_name"]: (r["accepted"], r["promoted"]) for r in feedback.report(got, specs, quality).collect()}
    assert marked["sales_style"] == (True, False) and marked["founder_led_growth"] == (False, False)
    errors = spark.createDataFrame([("topic:value_not_allowed:x", 4), ("fine:invalid_confidence", 1), ("fine:expected_boolean", 4)], "error string, count long")
    assert sorted((r["target"], r["field_name"], r["signal"]) for r in feedback.repair_signals(quality, errors, 10).collect()) == [("extraction", "fine", "malformed_answers"), ("extraction", "topic", "thin_evidence"), ("schema", "sales_style", "never_found"), ("schema", "topic", "values_missing")]
    judged = spark.createDataFrame([(1, None, "HIGH", [" no_records ", "", "no_records"]), (2, True, "odd", None)], "ordinal long, success boolean, confidence string, failure_modes array<string>")
    norm = {r["ordinal"]: r for r in feedback.normalized_judgements(judged).collect()}
    assert norm[1]["confidence"] == "high" and norm[1]["failure_modes"] == ["no_records"] and norm[2]["confidence"] == "low" and norm[2]["success"] and not norm[1]["answerable"]
    assert [(r["target"], r["signal"], r["share"]) for r in feedback.query_repair_signals(feedback.normalized_judgements(judged)).collect()] == [("planner", "no_records", 0.5)]


def test_negotiation(spark, corpus, tmp_path):
    docs = corpus.chunks.select("chunk_id", F.col("text").alias("bm25_text"))
    asked = spark.createDataFrame([(i, q) for i, q in enumerate(("calls with renewal risk", "weather", "RENEWALS", "pricing"))], "ordinal long, query string")
    assert negotiation.matching_tasks(spark.createDataFrame([("r", ["renewal", "pricing"]), ("s", ["zebra"])], "field_name string, terms array<string>"), asked, 2).collect() == [("r", [0, 2])]
    detail = negotiation.candidate_details(corpus.catalog["renewal_risk"])
    got = negotiation.evaluate(detail, corpus.silver, docs, corpus.catalog, asked)
    assert got["filter_records"] == 1 and got["matching_tasks"] and got["decision"] == "promote" and got["aggregation_groups"] == 1
    assert negotiation.evaluate({"field_name": "founder_led", "example_filters": {"founder_led": "x"}}, corpus.silver, docs, corpus.catalog, asked)["decision"] == "retrieval_only"
    assert negotiation.checked_verdict({"field_name": "a", "verdict": "accept", "confidence": 1}, {"a"})["confidence"] == 1.0
    for bad in (3, {"field_name": "b", "verdict": "accept"}, {"field_name": "a", "verdict": "maybe"}, {"field_name": "a", "verdict": "accept", "confidence": 2}):
        with pytest.raises(ValueError):
            negotiation.checked_verdict(bad, {"a"})
    assert negotiation.read_candidates(spark, str(tmp_path / "none")) == []
    (tmp_path / "field_candidates.json").write_text('[{"field_name": "a"}]')
    assert negotiation.read_candidates(spark, str(tmp_path)) == [{"field_name": "a"}]
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(ValueError):
        negotiation.read_candidates(spark, str(tmp_path / "bad.json"))


def test_loop_and_artifacts(spark, corpus, tmp_path):
    results = loop.run(corpus, ["founder led conversations", "Which calls mention pricing?"]).cache()
    assert results.count() == 4 and {r["phase"]: r["tasks"] for r in loop.totals(results).collect()} == {"before": 2, "after": 2}
    assert len(loop.per_task(results).collect()) == 2 and loop.session_metrics(results).first()["queries"] == 4
    events = [loop.event("search", 0, hits=3, tool="bm25"), loop.event("search", 1, hits=2)]
    answers = [Agent(corpus).answer("Which calls mention pricing?")]
    loop.publish(spark, str(tmp_path), answers, results, events)
    replay = sinks.read_document(spark, str(tmp_path / "task-which-calls-mention-pricing.replay.json"))
    assert replay["evidence"][0]["snippet"] == "[redacted]" and replay["query"].startswith("Which")
    assert {(r["kind"], r["metric"]): r["total"] for r in loop.event_metrics(loop.events_table(spark, events)).collect()} == {("search", "hits"): 5.0}
    assert "<h2>Totals</h2>" in spark.read.text(str(tmp_path / "report.html")).first()[0]
    assert {(r["column"], r["key"]) for r in loop.histograms(results).collect()} >= {("operation", "filter"), ("operation", "search")}
    assert loop.safe_stem("a b/c") == "a_b_c" and loop.shown([True, None, 1.50]) == "yes, -, 1.5" and loop.cut("abcdef", 5) == "ab..."


def test_contracts_and_publication(spark, corpus, tmp_path):
    specs = list(corpus.catalog.fields.values())
    d = contracts.dataset_digest(corpus.silver, "call_id")
    assert d == contracts.dataset_digest(corpus.silver.repartition(3), "call_id") != contracts.dataset_digest(corpus.silver.limit(2), "call_id") and len(d) == 12
    c = contracts.extraction_contract(specs)
    assert c["contract_hash"] == contracts.extraction_contract(specs)["contract_hash"] != contracts.extraction_contract(specs[1:])["contract_hash"]
    assert contracts.platform_contract(specs)["tables"]["silver_calls"]["columns"]["topic"] == "ARRAY<STRING>"
    wanted = contracts.evaluation_tasks(corpus.silver, corpus.catalog)
    assert len(wanted) == 6 and any(t["expected_call_ids"] == ["c1"] for t in wanted)
    made = spark.createDataFrame([(k, i, "a", t, [(1, "customer", t)]) for i, (k, t) in enumerate(SAID.items())], CALLS)
    got = sv.extract(made, corpus.chunks)
    wishes = spark.createDataFrame([("topic", 2, "high", "add_field")], "field_name string, count long, priority string, action string")
    sinks.publish(str(tmp_path / "run"), corpus.catalog, corpus.chunks, got, corpus.silver, sv.quality(got, made), trace=spark.createDataFrame([("s", "secret")], "tool string, text string"), feedback=wishes)
    docs = sinks.open_documents(spark, str(tmp_path / "run"))
    assert set(docs) == set(sinks.DOCUMENTS) and docs["manifest"]["dataset_digest"] and next(x for x in docs["schema_negotiation"] if x["field_name"] == "topic")["source"] == "schema+feedback"
    assert Agent(sinks.open_corpus(spark, str(tmp_path / "run"))).answer("Which calls mention pricing?")["judgement"]["success"]
    table = sv.catalog_table(spark, specs, sv.quality(got, made), wishes).collect()
    assert [r["field_name"] for r in table] == list(sv.FIELD_ORDER) and table[0]["requests"] == 2 and table[0]["good_for"]
    records = contracts.manifest_records(made, corpus.chunks).orderBy("call_id").collect()
    assert records[0]["chunk_ids"] == ["c1:chunk-001"]


def test_small_sources(spark, tmp_path, monkeypatch):
    (tmp_path / "env").write_text("# c\nexport A_X=1 # one\nB_X='two # 2'\nC_X=\"t\"\nnot a line\nHOME=/nowhere\n")
    monkeypatch.delenv("A_X", raising=False)
    assert extras.load_settings(str(tmp_path / "env")) == {"A_X": "1", "B_X": "two # 2", "C_X": "t"}
    for k in ("A_X", "B_X", "C_X"):
        monkeypatch.delenv(k)
    assert extras.parse_queries("a\n# no\n\nb\na\n") == ["a", "b"] and extras.parse_queries('{"query": "q"}\n{"query": " "}', ".jsonl") == ["q"]
    assert list(extras.collect_queries(["a ", "b", "quit", "c"])) == ["a", "b"]
    assert {"account", "call_id"} <= set(extras.observed_columns("SELECT x AS Account, y as `z1` FROM t")) and "z1" in extras.observed_columns("SELECT y as `z1`")
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert extras.run_sql(spark, "WITH c AS (SELECT * FROM t WHERE id > 1) SELECT v FROM c WHERE id IN (SELECT id FROM t)", {"t": t}).collect() == [("b",)]
    for bad in ("DROP TABLE t", "SELECT * FROM other", "INSERT INTO t SELECT 1, 'x'", "SELECT * FROM t WHERE id IN (SELECT 1 FROM secret)", "SELECT 1; SELECT 2", "SELECT reflect('java.lang.System', 'exit', 1)", "CREATE VIEW q AS SELECT 1"):
        with pytest.raises(ValueError):
            extras.run_sql(spark, bad, {"t": t})


def test_cached_embeddings(spark, tmp_path):
    count = tmp_path / "asked"
    count.mkdir()
    where = str(count)

    def client(texts):
        import os
        import uuid

        for _ in texts:
            open(os.path.join(where, uuid.uuid4().hex), "w").close()
        return [[float(len(t)), 1.0] for t in texts]

    docs = spark.createDataFrame([("a", "one"), ("b", "three"), ("c", "one")], "chunk_id string, embedding_text string")
    got = {r["chunk_id"]: r["embedding"] for r in extras.cached_embeddings(client, "m/1", docs, str(tmp_path / "cache")).collect()}
    assert got == {"a": [3.0, 1.0], "b": [5.0, 1.0], "c": [3.0, 1.0]} and len(list(count.iterdir())) == 2
    more = docs.union(spark.createDataFrame([("d", "four")], "chunk_id string, embedding_text string"))
    assert extras.cached_embeddings(client, "m/1", more, str(tmp_path / "cache")).count() == 4 and len(list(count.iterdir())) == 3
    assert extras.cached_embeddings(client, "m/2", docs, str(tmp_path / "cache")).count() == 3 and len(list(count.iterdir())) == 5


def test_calls_keep_place_and_metadata(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [[{"call_id": f"{f}{k}", "transcript": f"said {k}", "extra": k, "metadata": {"own": f"o{k}"}} for k in range(5)] for f in "ab"]
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(json.dumps(r) for r in rows[0]) + "\n")
    (tmp_path / "in" / "b.jsonl").write_text("\n\n" + "\n".join(json.dumps(r | {"pad": "x" * 500}) for r in rows[1]) + "\n")
    got = src.read_calls(spark, str(tmp_path / "in") + "/*.jsonl").orderBy("ordinal").collect()
    assert [r["call_id"] for r in got] == [f"{f}{k}" for f in "ab" for k in range(5)]
    assert got[0]["metadata"]["own"] == "o0" and got[0]["metadata"]["extra"] == "0" and got[0]["metadata"]["source_record_id"] == "a0" and got[0]["metadata"]["source_index"] == "call_records"
    assert got[0]["metadata"]["source_path"].endswith("a.jsonl:1") and got[5]["metadata"]["source_path"].endswith("b.jsonl:3")
    (tmp_path / "c.csv").write_text('id,transcript\n7,"hello\nthere, ""you"""\n,same\n,same\n')
    got = src.read_calls(spark, str(tmp_path / "c.csv")).orderBy("ordinal").collect()
    assert [len(r["turns"]) for r in got] == [2, 1, 1] and got[0]["call_id"] == "7" and got[0]["metadata"]["source_path"].endswith("c.csv:2") and len({r["call_id"] for r in got}) == 3
    mixed = spark.createDataFrame([("a", 1, '[{"speaker":"x","text":"hi"},"raw",7,null,{"text":""}]', "note"), ("b", 2, '{"best_text":"one"}', '{"k": 1}'), ("c", 3, "[broken", None)], "call_id string, ordinal long, calllog_result string, metadata string")
    at = {r["call_id"]: r for r in src.normalize_calls(mixed).collect()}
    assert [(t["turn_index"], t["speaker"], t["text"]) for t in at["a"]["turns"]] == [(1, "x", "hi"), (2, "unknown", "raw"), (3, "unknown", "7")]
    assert [t["text"] for t in at["b"]["turns"]] == ["one"] and at["a"]["metadata"]["raw_metadata"] == "note" and at["b"]["metadata"]["k"] == "1" and [t["text"] for t in at["c"]["turns"]] == ["[broken"]


def test_composed_counts_of_lists(spark):
    from siltstone.operators import aggregates

    df = spark.createDataFrame([("a", 1, ["x", "y"], "p"), ("b", 2, ["y"], "p"), ("c", 3, [], "q")], "call_id string, ordinal long, tags array<string>, kind string")
    catalog = Catalog.of(FieldSpec("tags", "list"), FieldSpec("kind", "string"))
    r = aggregates.evaluate("ratio(count(group_count(records, 'tags')), count(records))", df, catalog).frame.first()
    assert (r["numerator"], r["denominator"], r["ratio"]) == (2, 3, 0.6667)
    assert aggregates.evaluate("[count(group_count(records, 'tags')), count(group_count(records, 'kind')), count(records)]", df, catalog).frame.first()["result"] == [2.0, 2.0, 3.0]


def test_tokens_lose_possessives_only(spark):
    from siltstone.functions import text as tx

    said = ["Dog's its dogs's it's5 it'sx a'foo's b'bc O'Neil's_cat's", "rock'n'roll x's's ab's"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in said], "t string").select(tx.english_tokens("t")).collect()]
    import re

    want = [[w for w in (re.sub("'s$", "", t) for t in re.findall(tx.TOKEN, s.lower().replace("_", " "))) if len(w) >= 2 and w not in tx.ENGLISH_STOPWORDS] for s in said]
    assert got == want


def test_search_summary_and_variants(spark):
    docs = spark.createDataFrame([("a", "pricing talk"), ("b", "sales talk")], "chunk_id string, text string")
    q = spark.createDataFrame([(0, "pricing unheard"), (1, "zzz")], "query_id int, query string")
    hits = retrieval.bm25(docs, q, text="text")
    got = {r["query_id"]: r for r in retrieval.search_summary(q, hits).collect()}
    assert got[0]["missing_terms"] == ["unheard"] and got[0]["top"] == ["a"] and got[0]["failure_reason"] is None and got[1]["failure_reason"] == "no_chunks"
    from siltstone.functions.text import lexical_terms

    assert retrieval.lexical(docs, spark.createDataFrame([(0, "the talk")], "query_id int, query string"), terms=lexical_terms("query", ())).count() == 2
    assert retrieval.bm25(docs, spark.createDataFrame([(0, "the")], "query_id int, query string"), text="text").collect() == []
    with pytest.raises(ValueError):
        retrieval.bm25(docs, spark.range(21).selectExpr("cast(id as int) query_id", "'x y' query"), text="text")


def test_fixed_plan_pieces():
    assert pl.default_steps(pl.Plan("search", query="x"))[0].tool == "bm25_search_chunks"
