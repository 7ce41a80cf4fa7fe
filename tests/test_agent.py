import pytest
from pyspark.sql import functions as F

from siltstone.operators import chunking
from siltstone.operators import silver as sv
from siltstone.plans import planner as pl
from siltstone.plans.agent import Agent, Corpus, Guard
from siltstone.schemas import Catalog
from siltstone.streaming import ingest

SAID = {
    "call-001": ("Acme", "We need SSO and audit logs for the security review before rollout."),
    "call-002": ("Beta", "Pricing is blocking renewal and the budget is gone."),
    "call-003": ("Core", "Shipping delay again, coupon codes fail, refund please."),
    "call-004": ("Dune", "Founder led conversations about sales close better."),
}


@pytest.fixture(scope="module")
def corpus(spark):
    calls = spark.createDataFrame([(k, i, a, t, [(1, "customer", t)]) for i, (k, (a, t)) in enumerate(SAID.items())], "call_id string, ordinal long, account_name string, transcript string, turns array<struct<turn_index:int,speaker:string,text:string>>")
    chunks = chunking.pack(calls).cache()
    specs = sv.builtin_specs()
    got = sv.extract(calls, chunks)
    return Corpus(sv.pivot(calls, got, specs).cache(), chunks, Catalog.of(*specs))


def test_filter_question(corpus):
    got = Agent(corpus).answer("Which calls mention pricing?")
    assert [r["call_id"] for r in got["records"]] == ["call-002"] and got["judgement"]["success"]
    assert got["evidence"][0]["chunk_id"] == "call-002:chunk-001"


def test_aggregate_question(corpus):
    got = Agent(corpus).answer("How many calls per complaint?")
    assert got["aggregation"] == {"coupon_confusion": 1, "refund_policy": 1, "shipping_delay": 1}


def test_search_question_asks_for_a_field(corpus):
    got = Agent(corpus).answer("founder led conversations")
    assert got["plan"].operation == "search" and got["records"][0]["call_id"] == "call-004"
    request = got["column_requests"][0]
    assert request.action == "add_field" and got["judgement"]["needs_cu_feedback"]
    better = Catalog.of(*pl.feedback_specs(list(corpus.catalog.fields.values()), [request]))
    assert "founder_led_conversations" in pl.HeuristicPlanner().plan("founder led conversations", better).filters


def test_embeddings(corpus, spark):
    class Client:
        def embed(self, texts):
            return [[1.0, 0.0] if "founder" in t else [0.0, 1.0] for t in texts]

    vectors = corpus.chunks.select("chunk_id", F.when(F.lower("text").contains("founder"), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).alias("embedding"))
    with_vectors = Corpus(corpus.silver, corpus.chunks, corpus.catalog, vectors, Client())

    class Fixed:
        def plan(self, query, catalog):
            return pl.Plan("search", query=query, steps=(pl.Step("embedding_search_chunks", {"query": query, "limit": 1, "promote_records": True}), pl.Step("search_chunks", {"queries": ["refund", "Refund!", "pricing"], "mode": "hybrid"}), pl.Step("fetch_chunks")))

    got = Agent(with_vectors, Fixed()).answer("founder led conversations")
    assert got["records"][0]["call_id"] == "call-004"


def test_bind_and_steps(corpus):
    p = pl.bind({"operation": "aggregate", "group_by": "topic", "steps": [{"tool": "aggregate_silver", "arguments": {"group_by": "topic"}}]}, "q", corpus.catalog)
    assert [s.tool for s in p.steps] == ["query_silver", "aggregate_silver", "fetch_chunks", "review_schema_gaps"]
    assert pl.bind({"operation": "search", "filters": {"urgency": "high"}}, "q", corpus.catalog).filters == {}
    for bad in ({"operation": "drop"}, {"operation": "filter", "steps": [{"tool": "run_sql"}]}, {"operation": "aggregate"}, {"operation": "filter", "filters": {"nope": 1}}):
        with pytest.raises(ValueError):
            pl.bind(bad, "q", corpus.catalog)


def test_replan_and_guard(corpus):
    class Twice:
        def plan(self, query, catalog):
            return pl.Plan("filter", {"urgency": "high"}, query=query, steps=(pl.Step("query_silver", {"filters": {"urgency": "high"}}),), evidence=False)

        def replan(self, query, catalog, seen):
            assert "no_records" in seen["judgement"]["failure_modes"]
            return pl.Plan("filter", {"urgency": "medium"}, query=query, steps=(pl.Step("query_silver", {"filters": {"urgency": "medium"}}),), evidence=False)

    assert [r["call_id"] for r in Agent(corpus, Twice()).answer("x")["records"]] == ["call-001"]

    class Broken:
        def plan(self, query, catalog):
            return pl.Plan("filter", query=query, steps=(pl.Step("nope"),) * 5)

    got = Agent(corpus, Broken(), guard=Guard(max_errors=2)).answer("x")
    assert len(got["trace"]) == 2 and "guardrail:max_errors" in got["judgement"]["failure_modes"]


def test_stream(spark, tmp_path):
    rows = [("a", 1, "2026-01-01 00:00:00", [(1, "s", "hi"), (2, "s", "y" * 950)]), ("a", 1, "2026-01-01 00:00:00", [(1, "s", "hi"), (2, "s", "y" * 950)])]
    df = spark.createDataFrame(rows, "call_id string, ordinal long, ts string, turns array<struct<turn_index:int,speaker:string,text:string>>")
    df.withColumn("ts", F.to_timestamp("ts")).write.json(str(tmp_path / "in"))
    q = ingest.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
