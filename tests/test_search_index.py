"""The stored index against the scan that it replaces: rows, files read, windows left out, and batches."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from siltstone.operators import retrieval
from siltstone.operators import search_index as si
from siltstone.streaming import indexing, ingest

SCHEMA = "chunk_id long, bm25_text string, lang string"


def texts(n, seed=0, rare=3):
    rng = random.Random(seed)
    words = [f"w{int(k ** 1.5)}" for k in range(60)]
    out = []
    for i in range(n):
        own = rng.choices(words, weights=[1 / (k + 1) for k in range(60)], k=rng.choice((0, 3, 20, 20, 200)))
        if i % (n // rare) == 1:
            own += ["needle"] * (1 + i % 4)
        out.append((i, " ".join(own) if i % 11 else None, rng.choice(("en", "de"))))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(600), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(0, "w0 needle"), (1, "w0 w1 w2 w5"), (2, "the of"), (3, "unheard"), (4, "w464 w0"), (5, "needle needle")], "query_id int, query string")


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    found = si.SearchIndex(spark, str(tmp_path_factory.mktemp("index")))
    keep, si.WINDOW = si.WINDOW, 32
    found.add(docs, "all", buckets=8)
    si.WINDOW = keep
    return found


def rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "chunk_id", "score", "matched_terms", "rank").collect())


@pytest.mark.parametrize("limit", [1, 7, 50, None])
def test_same_rows_as_the_scan(docs, queries, index, limit):
    assert rows(index.search(queries, limit)) == rows(retrieval.bm25(docs, queries, limit))
    german = docs.where("lang = 'de'").select("chunk_id")
    assert rows(index.search(queries, limit, german)) == rows(retrieval.bm25(docs, queries, limit, german))


def test_ties_go_to_the_lesser_id(spark, tmp_path):
    same = spark.createDataFrame([(i, "alike words here", "en") for i in range(90, 0, -1)], SCHEMA)
    found = si.SearchIndex(spark, str(tmp_path))
    found.add(same)
    q = spark.createDataFrame([("q", "alike words")], "query_id string, query string")
    assert [r["chunk_id"] for r in found.search(q, 5).orderBy("rank").collect()] == [1, 2, 3, 4, 5]


def test_windows_that_cannot_reach_the_hits_are_left_out(spark, queries, index):
    told = {}
    index.search(queries.where("query_id = 0"), 3, told=told).collect()
    assert told["windows"] >= 20 and told["scored"] <= told["windows"] / 2


def scanned(df):
    """Files and bytes that a plan without a shuffle reads."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    leaf = plan.collectLeaves().head()
    return int(leaf.metrics().apply("numFiles").value())


def test_only_the_buckets_of_the_terms_are_read(spark, index):
    every = {f for f in index.blocks().inputFiles()}
    bucket = zlib.crc32(b"needle") % 8
    own = [f for f in every if f"/bucket={bucket}/" in f]
    assert 0 < len(own) < len(every) / 3
    assert scanned(index.postings_of(["needle"]).select("term", "n")) == len(own)
    plan = index.postings_of(["needle"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,needle)]" in plan or "In(term" in plan


def test_no_block_holds_more_than_a_window(index, docs):
    sizes = [r["n"] for r in index.blocks().select("n").collect()]
    assert max(sizes) <= 3 * 32  # windows are filled by hash
    total = docs.select(F.size(retrieval.english_tokens("bm25_text")).alias("n")).where("n >= 0")
    assert index.statistics() == (600, pytest.approx(total.agg(F.sum("n")).first()[0] / 600))


def test_the_front_bounds_a_block(index):
    for r in index.blocks().collect():
        pairs = {(p["tf"], p["dl"]) for p in r["postings"]}
        front = {(p["tf"], p["dl"]) for p in r["front"]}
        assert front == {p for p in pairs if not any(q != p and q[0] >= p[0] and q[1] <= p[1] for q in pairs)}
        assert r["n"] == len(r["postings"]) and r["said"] == sum(p["tf"] for p in r["postings"])


def test_batches_equal_a_rebuild(spark, docs, queries, index, tmp_path):
    grown = si.SearchIndex(spark, str(tmp_path))
    for k in range(4):
        indexing.index_batch(grown, docs.where(F.col("chunk_id") % 4 <= k), k, most_segments=99)  # each brings the earlier ones again
    before = (grown.statistics(), sorted(map(tuple, grown.frequencies().collect())))
    indexing.index_batch(grown, docs.limit(50), 2, most_segments=99)  # a replay, even of other rows, changes nothing
    assert (grown.statistics(), sorted(map(tuple, grown.frequencies().collect()))) == before
    assert grown.statistics() == index.statistics() and before[1] == sorted(map(tuple, index.frequencies().collect()))
    assert rows(grown.search(queries, 7)) == rows(index.search(queries, 7))
    assert len(grown.segments()) == 4
    grown.compact("merged")
    assert [s.name for s in grown.segments()] == ["merged"] and len(grown.sweep()) == 4
    assert rows(grown.search(queries, 7)) == rows(index.search(queries, 7)) and grown.statistics() == index.statistics()
    indexing.index_batch(grown, docs, 1)  # still known after the merge
    assert grown.statistics() == index.statistics()


def test_what_was_not_committed_does_not_count(spark, docs, queries, tmp_path, monkeypatch):
    torn = si.SearchIndex(spark, str(tmp_path))
    torn.add(docs.where("chunk_id < 300"), "one")
    monkeypatch.setattr(si.SearchIndex, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        torn.add(docs.where("chunk_id >= 400"), "two")
    monkeypatch.undo()
    assert torn.statistics()[0] == 300
    torn.add(docs.where("chunk_id >= 300"), "two")  # written anew
    assert torn.statistics()[0] == 600 and rows(torn.search(queries, 9)) == rows(retrieval.bm25(docs, queries, 9))


def test_empty_and_odd_rows(spark, queries, tmp_path):
    none = si.SearchIndex(spark, str(tmp_path / "a"))
    assert none.search(queries).collect() == [] and none.statistics() == (0, 0.0) and none.compact() is None
    none.add(spark.createDataFrame([], SCHEMA))
    assert none.search(queries).collect() == []
    odd = spark.createDataFrame([(None, "w0", "x", 1), (5, None, "x", 1), (6, "", "x", 1), (7, "w0 " * 30000, "x", 1), (7, "w0 w1", "x", 1), (8, "w0", "x", 1)], "chunk_id long, bm25_text string, term string, tf int")
    some = si.SearchIndex(spark, str(tmp_path / "b"))
    some.add_new(odd, "x")
    assert some.statistics()[0] == 4
    assert {r["chunk_id"] for r in some.search(queries.where("query_id = 1")).collect()} == {7, 8}
    words = si.SearchIndex(spark, str(tmp_path / "c"), id_type="string")
    words.add(odd.where("chunk_id = 8").selectExpr("'call-1' as chunk_id", "bm25_text"))
    assert [r["chunk_id"] for r in words.search(queries).collect()] == ["call-1"] * 3


def test_a_stream_of_calls_is_indexed_once(spark, tmp_path):
    calls = [(f"c{k}", k, "2026-01-01 00:00:00", [(1, "s", f"needle number{k}"), (2, "s", "hay " * 300)]) for k in range(6)]
    for k in range(3):
        part = calls[2 * k : 2 * k + 2] + calls[:1]
        spark.createDataFrame(part, "call_id string, ordinal long, ts string, turns array<struct<turn_index:int,speaker:string,text:string>>").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    index = si.SearchIndex(spark, str(tmp_path / "index"), id_type="string")
    for _ in range(2):
        stream = ingest.chunks_of(ingest.read_stream(spark, str(tmp_path / "in"), max_files=1))
        indexing.start(stream, index, str(tmp_path / "ck"), most_segments=2).awaitTermination(240)
        assert index.statistics()[0] == 12
        q = spark.createDataFrame([(0, "needle"), (1, "number3")], "query_id int, query string")
        assert [(r["query_id"], r["chunk_id"]) for r in index.search(q).orderBy("query_id", "rank").collect()] == [(0, f"c{k}:chunk-001") for k in range(6)] + [(1, "c3:chunk-001")]


def test_one_exchange_writes_a_segment(spark, tmp_path):
    some = si.SearchIndex(spark, str(tmp_path))
    src = spark.createDataFrame(texts(30), SCHEMA).select(F.col("chunk_id").alias("id"), F.col("bm25_text").alias("text"))
    plan = some._blocks_of(src, retrieval.english_tokens, 8, 40)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("translate(lower(") == 1


def test_filled_segments_are_merged_where_they_are(spark, docs, queries, tmp_path, monkeypatch):
    monkeypatch.setattr(si, "WINDOW", 32)
    grown = si.SearchIndex(spark, str(tmp_path))
    for name, part in (("a", "chunk_id < 300"), ("b", "chunk_id between 300 and 309"), ("c", "chunk_id between 310 and 320"), ("d", "chunk_id > 320")):
        grown.add_new(docs.where(part), name, buckets=8)
    assert "Exchange" not in grown._merged([s for s in grown.segments() if s.n > 32])._jdf.queryExecution().executedPlan().toString()
    grown.compact("merged")
    assert grown.statistics()[0] == 600 and rows(grown.search(queries, 9)) == rows(retrieval.bm25(docs, queries, 9))
    assert max(r["n"] for r in grown.blocks().collect()) <= 3 * 32
