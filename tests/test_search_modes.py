"""What was asked is what is searched: every query of a fan-out, by the tool and the mode of the step, within its filters; and answers against SQL and brute force."""

import json
import math
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from siltstone.functions.text import ENGLISH_STOPWORDS
from siltstone.operators import chunking, retrieval
from siltstone.operators import silver as sv
from siltstone.operators.search_index import SearchIndex
from siltstone.plans import model, registry, views
from siltstone.plans import planner as pl
from siltstone.plans.agent import Agent, Corpus, routed
from siltstone.schemas import Catalog

SAID = {
    "c1": "We need SSO and audit logs before rollout.",
    "c2": "Pricing is blocking renewal and the budget is gone.",
    "c3": "Shipping delay again, coupon codes fail, refund please.",
    "c4": "Founder led conversations about sales close better.",
    "c5": "Refund of the founder plan, pricing unclear.",
}
WORDS = ("sso", "pricing", "refund", "founder")


class Client:
    def __init__(self):
        self.asked = []

    def embed(self, texts):
        self.asked.append(list(texts))
        return [[float(w in t.lower()) for w in WORDS] + [0.01] for t in texts]


@pytest.fixture(scope="module")
def corpus(spark):
    calls = spark.createDataFrame([(k, i, f"acc {k}", t, [(1, "customer", t)]) for i, (k, t) in enumerate(SAID.items())], "call_id string, ordinal long, account_name string, transcript string, turns array<struct<turn_index:int,speaker:string,text:string>>").coalesce(2)
    chunks = chunking.pack(calls).cache()
    specs = sv.builtin_specs()
    got = sv.extract(calls, chunks)
    vectors = chunks.select("chunk_id", F.array(*[F.lower("text").contains(w).cast("double") for w in WORDS], F.lit(0.01)).alias("embedding")).cache()
    made = Corpus(sv.pivot(calls, got, specs).cache(), chunks, Catalog.of(*specs), vectors, Client())
    made.documents.count()
    return made


def searched(corpus, tool, controller=None, operation="filter", **arguments):
    class Fixed:
        def plan(self, query, catalog):
            return pl.Plan(operation, query=query, steps=(pl.Step(tool, arguments),), evidence=False)

    corpus.controller = controller
    agent = Agent(corpus, Fixed())
    state = []
    agent._text = lambda plan, s: state.append(s) or ""
    got = agent.answer("founder refund")
    corpus.controller = None
    return state[0], got["trace"][0]["result"]


ids = lambda state: {c.split(":")[0] for c in state.chunks}


@pytest.mark.parametrize(("tool", "mode", "how"), [("bm25_search_chunks", None, "bm25"), ("search_chunks", "lexical", "lexical"), ("embedding_search_chunks", None, "embedding"), ("search_chunks", "embedding", "embedding"), ("bm25_search_chunks", "hybrid", "hybrid"), ("bm25_search_chunks", "lexical", "bm25"), ("embedding_search_chunks", "hybrid", "embedding"), ("search_chunks", None, "bm25")])
def test_tools_are_routed(tool, mode, how):
    assert routed(tool, mode) == how


@pytest.mark.parametrize("how", [("bm25_search_chunks", None), ("search_chunks", "lexical"), ("embedding_search_chunks", None), ("search_chunks", "hybrid")])
def test_every_query_of_a_fan_out_is_searched(corpus, how):
    tool, mode = how
    before = len(corpus.client.asked)
    state, note = searched(corpus, tool, queries=["sso audit", "refund", "pricing", "Refund!"], limit=2, mode=mode)
    assert note.endswith("for 3 queries") and not state.failures and {"c1", "c3", "c5", "c2"} <= ids(state)
    assert {(c["query_id"], c["rank"]) for c in state.chunks.values()} <= {(q, r) for q in range(3) for r in (1, 2)}
    if tool.startswith("embedding") or mode == "hybrid":
        assert corpus.client.asked[before:] == [["sso audit", "refund", "pricing"]]  # one request for all


def test_only_queries_that_ran_and_found_nothing_failed(corpus):
    state, _ = searched(corpus, "bm25_search_chunks", queries=["refund", "zzqqxx"])
    assert [f["query"] for f in state.failures] == ["zzqqxx"]
    bare = Corpus(corpus.silver, corpus.chunks, corpus.catalog)
    state, note = searched(bare, "search_chunks", queries=["refund"], mode="hybrid")
    assert note.startswith("error: no embeddings") and not state.failures


@pytest.mark.parametrize("how", [("bm25_search_chunks", None), ("search_chunks", "lexical"), ("embedding_search_chunks", None), ("search_chunks", "hybrid"), ("search_chunks", "agentic")])
def test_filters_hold_in_every_mode(corpus, how):
    name, value = next((n, v) for n, s in corpus.catalog.fields.items() if s.type == "list" for v in s.allowed_values if corpus.silver.where(F.array_contains(n, v)).count() in (1, 2))
    own = {r["call_id"] for r in corpus.silver.where(F.array_contains(name, value)).collect()}
    state, _ = searched(corpus, how[0], queries=["founder refund pricing sso shipping renewal"], mode=how[1], filters={name: value}, limit=5)
    assert ids(state) and ids(state) <= own


def test_the_controllers_tools_are_the_ones_that_run(corpus, monkeypatch):
    replies = iter([json.dumps({"tool": "embedding_search_chunks", "query": "pricing"}), json.dumps({"tool": "search_chunks", "query": "coupon"}), json.dumps({"done": True})])
    shown, ran, hits = [], [], Corpus.hits
    monkeypatch.setattr(Corpus, "hits", lambda self, tool, mode, asked, limit, allowed=None: ran.append((tool, routed(tool, mode), *asked)) or hits(self, tool, mode, asked, limit, allowed))
    state, note = searched(corpus, "search_chunks", lambda r: shown.append(r) or next(replies), mode="agentic", queries=["founder"], limit=3)
    assert ran == [("bm25_search_chunks", "bm25", "founder"), ("embedding_search_chunks", "embedding", "pricing"), ("search_chunks", "lexical", "coupon")]
    assert note.endswith("for 3 queries") and {"c4", "c2", "c3"} <= ids(state)
    assert shown[0]["tools"] == ["bm25_search_chunks", "search_chunks", "embedding_search_chunks"] and shown[0]["calls"][0]["result_count"] == 2


def test_questions_are_searched_side_by_side_by_agents(corpus):
    state, note = searched(corpus, "search_chunks", mode="agentic", queries=["founder", "coupon codes", "sso"], limit=3)
    assert {"c1", "c3", "c4"} <= ids(state) and int(note.split()[-2]) >= 3


def test_a_stored_index_answers_the_agent(corpus, spark, tmp_path):
    index = SearchIndex(spark, str(tmp_path), id_type="string")
    index.add(corpus.documents.select("chunk_id", "bm25_text"), "all")
    plain, _ = searched(corpus, "bm25_search_chunks", queries=["refund", "founder pricing"])
    corpus.index = index
    stored, _ = searched(corpus, "bm25_search_chunks", queries=["refund", "founder pricing"])
    corpus.index = None
    assert stored.chunks == plain.chunks


def test_batches_equal_single_searches(corpus, spark):
    vectors = corpus.client.embed(["refund founder", "sso"])
    both = retrieval.embedding_batch(corpus.vectors, list(enumerate(vectors)), 3)
    for k, v in enumerate(vectors):
        one = [(r["chunk_id"], r["score"], r["rank"]) for r in retrieval.embedding(corpus.vectors, v, 3).collect()]
        assert sorted(one) == sorted((r["chunk_id"], r["score"], r["rank"]) for r in both.where(f"query_id = {k}").collect())
    a = spark.createDataFrame([(0, "x", 1), (0, "y", 2), (1, "x", 1)], "query_id int, chunk_id string, rank int")
    b = spark.createDataFrame([(0, "z", 1), (0, "x", 2), (1, "q", 1)], "query_id int, chunk_id string, rank int")
    assert sorted(map(tuple, retrieval.zipped(a, b, 2).collect())) == [(0, "x", 1), (0, "z", 2), (1, "q", 2), (1, "x", 1)]
    with pytest.raises(ValueError):
        retrieval.embedding_batch(corpus.vectors, [(k, [1.0]) for k in range(21)])


def test_views_show_a_model_what_it_needs(corpus):
    records = [{"call_id": f"c{k}", "account_name": "a", "date": None, "topic": ["x"], "evidence_refs": {}, "quality_flags": None} for k in range(20)]
    assert len(model.record_view(records, ("topic",))) == 12 and model.record_view(records, ("topic", "gone"))[0] == {"call_id": "c0", "account_name": "a", "date": None, "fields": {"topic": ["x"]}, "quality_flags": []}
    assert model.evidence_view([{"chunk_id": "1", "call_id": "2", "snippet": "s", "score": 1}] * 10) == [{"chunk_id": "1", "call_id": "2", "snippet": "s", "matched_terms": []}] * 8
    calls = [{"tool": "t", "query": f"q{k}", "chunks": list("abcde"), "missing": ["m"]} for k in range(9)]
    assert [c["query"] for c in model.search_view(calls)] == [f"q{k}" for k in range(3, 9)] and model.search_view(calls)[0]["top_chunks"] == ["a", "b", "c"]
    fields = model.field_view(corpus.catalog)
    assert len(fields) == len(corpus.catalog.fields) and set(fields[0]) == {"name", "type", "description", "allowed_values", "filterable", "aggregatable"}
    seen = model.replan_view({"judgement": {"success": False, "failure_modes": ["no_records"], "missing_field_requests": list(range(9))}, "records": [1, 2], "failures": list(range(7))})
    assert seen == {"failure_modes": ["no_records"], "success": False, "counts": {"records": 2, "chunks": 0}, "column_requests": [0, 1, 2, 3], "search_failures": [0, 1, 2, 3]}
    assert model.replan_view({})["counts"] == {"records": 0, "chunks": 0}


def test_names_come_from_what_wasnt_found():
    assert pl.values_of("Which calls mention SOC-2/audit (logs)?") == ["soc", "audit", "logs"]
    assert pl.values_of("the x", [{"missing_terms": ["Renewal!", "a"], "query_terms": ["renewal", "risk"]}]) == ["renewal", "risk"]


# ---- registered answers ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    c.execute(f"CREATE TABLE told AS WITH RECURSIVE {views.CHUNKS_SQL} SELECT * FROM chunks")
    return c


def answered(spark, sf_dir, name, kind):
    return [(r["value"], r["count"]) for r in registry.QUERIES[name](spark, sf_dir).collect() if r["kind"] == kind]


def test_filtered_answers_are_those_of_sql(spark, sf_dir, duck):
    whole = "SELECT CAST(conv_id AS VARCHAR) AS call_id, min(conv_id) AS o, lower(string_agg(trim(text), chr(10) ORDER BY turn)) AS said FROM conversations WHERE trim(text) <> '' GROUP BY 1"
    want = duck.execute(f"SELECT call_id FROM ({whole}) WHERE contains(said, 'the')").fetchall()
    got = [v for v, _ in answered(spark, sf_dir, "agent_answer_filter", "record")]
    assert set(got) <= {w[0] for w in want} and len(got) == min(50, len(want)) and len(set(got)) == len(got)
    groups = {w: duck.execute(f"SELECT count(*) FROM ({whole}) WHERE contains(said, '{w}')").fetchone()[0] for w in ("the", "and", "with")}
    assert dict(answered(spark, sf_dir, "agent_answer_aggregate", "group")) == {w: n for w, n in groups.items() if n}


def test_searched_answers_are_those_of_brute_force(spark, sf_dir, duck):
    corpus = registry._corpus(spark, sf_dir)
    docs = {r["chunk_id"]: (r["call_id"], r["bm25_text"]) for r in corpus.documents.collect()}
    assert set(docs) == {r[0] for r in duck.execute("SELECT chunk_id FROM told").fetchall()}
    tokens = lambda t: [w for w in (re.sub("'s$", "", x) for x in re.findall("[a-z0-9]+(?:'[a-z]+)?", t.lower().replace("_", " "))) if len(w) > 1 and w not in ENGLISH_STOPWORDS]
    said = {i: Counter(tokens(t)) for i, (_, t) in docs.items()}
    length = {i: sum(c.values()) for i, c in said.items()}
    n, average = len(docs), sum(length.values()) / len(docs)
    score = Counter()
    for term in set(tokens("the call with the need")):
        df = sum(term in c for c in said.values())
        for i, c in said.items():
            if c[term]:
                score[i] += round(math.log(1 + (n - df + 0.5) / (df + 0.5)) * c[term] * 2.2 / (c[term] + 1.2 * (0.25 + 0.75 * length[i] / max(average, 1.0))), 6)
    best = sorted(score, key=lambda i: (-score[i], i))[:10]
    want = list(dict.fromkeys(docs[i][0] for i in best))
    assert [v for v, _ in answered(spark, sf_dir, "agent_answer_search", "record")] == want
    assert {v for v, _ in answered(spark, sf_dir, "agent_answer_search", "evidence")} <= set(docs)
