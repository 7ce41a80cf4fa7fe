"""Batches with a check between, jobs side by side, guardrails over a stream, remote models, traces, table functions and typed JSON."""

import json
import threading
import time
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from siltstone.functions import tables
from siltstone.functions import text as tx
from siltstone.operators import negotiation, retrieval, validation
from siltstone.operators.search_index import SearchIndex
from siltstone.plans import tracing
from siltstone.plans.batches import Batches
from siltstone.plans.concurrent import together
from siltstone.plans.usage import BudgetGuard, Usage
from siltstone.schemas import FieldSpec
from siltstone.sources import remote, variants
from siltstone.streaming import guards

# ---- batches -------------------------------------------------------------------------------------


@pytest.fixture
def asked_once(spark, tmp_path):
    """A run over ten calls whose model leaves a file per request."""
    log = tmp_path / "asked"
    log.mkdir()
    calls = spark.createDataFrame([(f"c{k}", 100 - k) for k in range(10)], "call_id string, ordinal long").repartition(3)
    chunks = spark.createDataFrame([(f"c{k}", 1, f"c{k}:1", "text") for k in range(10)], "call_id string, chunk_index int, chunk_id string, text string")
    specs = [FieldSpec("topic", "string")]

    def client(request):
        (log / f"{request['call_id']}-{uuid.uuid4().hex}").touch()
        return json.dumps({"fields": [{"name": "topic", "value": request["call_id"], "confidence": "high", "evidence_refs": [f"chunk:{request['call_id']}:1"], "abstained": False, "rationale": ""}]})

    work = lambda some: validation.extract_with(client, specs, some.drop("ordinal"), chunks)
    asked = lambda: sorted(p.name.split("-")[0] for p in log.iterdir())
    return lambda **more: Batches(spark, str(tmp_path / "run"), calls, work, 3, {"high": F.count_if(F.col("confidence") == "high")}, **more), asked


def test_a_stopped_run_asks_each_call_once(asked_once):
    made, asked = asked_once
    got = made(check=lambda batch, total: "enough" if total["high"] >= 6 else None).run()
    assert got == {"batches": 4, "done": 2, "stopped": "enough", "totals": {"rows": 6, "high": 6}}
    assert asked() == ["c4", "c5", "c6", "c7", "c8", "c9"]  # the first six by ordinal
    got = made().run()
    assert got["done"] == 4 and got["stopped"] is None and got["totals"] == {"rows": 10, "high": 10}
    assert asked() == sorted(f"c{k}" for k in range(10))
    run = made()
    assert run.run()["done"] == 4 and len(asked()) == 10  # nothing is left to do
    assert {(r["call_id"], r["value_str"], r["batch"]) for r in run.result().collect()} == {(f"c{k}", f"c{k}", (9 - k) // 3) for k in range(10)}


def test_a_run_lost_within_a_batch_goes_on_after_the_last_whole_one(asked_once, monkeypatch):
    made, asked = asked_once
    run = made()
    one = run._one
    monkeypatch.setattr(run, "_one", lambda k, plan: one(k, plan) if k < 1 else (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        run.run()
    assert run.result().count() == 3 and len(asked()) == 3
    assert made().run()["done"] == 4 and len(asked()) == 10


def test_a_batch_over_its_time_is_cancelled(spark, tmp_path):
    calls = spark.createDataFrame([("a", 1), ("b", 2)], "call_id string, ordinal long")

    def slow(batches):
        for b in batches:
            if b.num_rows and b.column("call_id")[0].as_py() == "b":
                time.sleep(60)
            yield b

    run = Batches(spark, str(tmp_path), calls, lambda some: some.repartition(1).mapInArrow(slow, "call_id string, ordinal long"), 1, max_seconds=6)
    began = time.monotonic()
    with pytest.raises(Exception, match="(?i)cancel"):
        run.run()
    assert time.monotonic() - began < 50 and [r["batch"] for r in run.ledger()] == [0]


def test_no_calls_make_no_batches(spark, tmp_path):
    run = Batches(spark, str(tmp_path), spark.createDataFrame([], "call_id string, ordinal long"), lambda some: some)
    assert run.run() == {"batches": 0, "done": 0, "stopped": None, "totals": {}}


# ---- side by side --------------------------------------------------------------------------------


def test_jobs_overlap_and_keep_their_order(spark):
    now, most, lock = [0], [0], threading.Lock()

    def task(k):
        def run():
            with lock:
                now[0] += 1
                most[0] = max(most[0], now[0])
            got = spark.range(100).where(f"id % 10 = {k}").count(), spark.sparkContext.getLocalProperty("spark.scheduler.pool"), spark.sparkContext.getLocalProperty("probe")
            time.sleep(0.3)
            with lock:
                now[0] -= 1
            return k, *got

        return run

    spark.sparkContext.setLocalProperty("probe", "from the caller")
    got = together(spark, [task(k) for k in range(6)], at_once=3)
    spark.sparkContext.setLocalProperty("probe", None)
    assert got == [(k, 10, f"branches-{k % 3}", "from the caller") for k in range(6)] and 2 <= most[0] <= 3
    assert got == [(k, n, f"branches-{k % 3}", p) for k, n, _, p in (task(k)() for k in range(6)) for p in ["from the caller"]]  # as one after another


def test_a_failure_cancels_the_others(spark):
    def fails():
        time.sleep(1)
        raise ValueError("no")

    def endless():
        return spark.range(4).repartition(4).mapInArrow(_waits, "id long").count()

    began = time.monotonic()
    with pytest.raises(ValueError, match="no"):
        together(spark, [endless, fails, endless], at_once=2)
    assert time.monotonic() - began < 45
    assert together(spark, []) == [] and together(spark, [lambda: 5]) == [5]


def _waits(batches):
    for b in batches:
        time.sleep(60)
        yield b


# ---- guardrails ----------------------------------------------------------------------------------

EVENTS = [
    # run, seconds, ok, cost
    ("errors", 0, True, 0.1), ("errors", 1, False, 0.1), ("errors", 2, False, None), ("errors", 3, True, 0.0), ("errors", 4, False, 0.0), ("errors", 5, False, 0.0), ("errors", 6, False, 0.0), ("errors", 7, False, 9.0),
    ("money", 0, True, 0.5), ("money", 2, False, 0.4), ("money", 3, True, 0.1), ("money", 4, True, 5.0),
    ("slow", 0, True, 0.0), ("slow", 15, True, 0.0), ("slow", 31, False, 0.0), ("slow", 32, True, 9.0),
    ("silent", 1, True, 0.0), ("fine", 0, True, 0.2), ("fine", 20, False, 0.2),
]


def by_guard(max_errors, max_usd, max_seconds):
    """What a guard on the driver says of each run, its clock moved by hand; a run that falls silent is asked again at the end."""
    out = {}
    for run in dict.fromkeys(e[0] for e in EVENTS):
        own = [e for e in EVENTS if e[0] == run]
        guard = BudgetGuard(max_errors=max_errors, max_seconds=max_seconds, max_usd=max_usd, usage=Usage({"m": (1e6, 1e6)}))
        for _, at, ok, cost in own:
            guard.began = time.monotonic() - (at - own[0][1])
            if guard.stopped():
                break
            guard.usage.rates = {**guard.usage.rates, f"{at}": (1e6 * (cost or 0), 0.0)}
            guard.usage.saw(f"{at}", 1, 0)
            guard.saw(ok)
            if guard.stopped():
                break
        guard.began = time.monotonic() - 10_000
        guard.stopped()
        if guard.reason:
            out[run] = guard.reason
    return out


def test_a_stream_of_events_stops_what_the_guard_stops(spark, tmp_path):
    rows = spark.createDataFrame([(r, s, ok, c) for r, s, ok, c in EVENTS], "run_id string, s int, ok boolean, cost_usd double").selectExpr("run_id", "timestamp_seconds(1700000000 + s) as at", "ok", "cost_usd")
    for k, part in enumerate(("s < 3", "s >= 3 and s < 6", "s >= 6")):
        rows.where(part).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        time.sleep(1.1)  # files are read in the order of their times
    late = spark.createDataFrame([(None, 900, True, 0.0), ("other", 900, True, 0.0)], "run_id string, s int, ok boolean, cost_usd double").selectExpr("run_id", "timestamp_seconds(1700000000 + s) as at", "ok", "cost_usd")
    late.coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    keep = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(guards.EVENT).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        query = guards.stops(stream, 3, 1.0, 30).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination(240)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", keep)
    got = {r["run_id"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {k: r["reason"] for k, r in got.items() if k != "other"} == by_guard(3, 1.0, 30) == {"errors": "max_errors", "money": "budget", "slow": "timeout", "silent": "timeout", "fine": "timeout"}
    assert got["errors"]["events"] == 7 and got["errors"]["errors"] == 3 and got["money"]["cost_usd"] == 1.0 and got["slow"]["events"] == 2


# ---- remote models -------------------------------------------------------------------------------


class Server:
    """A model that fails as it is told to, and a log."""

    def __init__(self):
        self.posts, self.seen, self.lock, outer = [], {}, threading.Lock(), self
        self.log = [{"position": k, "request_id": f"r{k}", "body": {"k": k}} for k in range(7)]

        class Handler(BaseHTTPRequestHandler):
            def log_message(self, *args):
                pass

            def _say(self, status, text):
                self.send_response(status)
                self.end_headers()
                self.wfile.write(text.encode())

            def do_GET(self):  # noqa: N802
                asked = dict(p.split("=") for p in self.path.partition("?")[2].split("&"))
                since = int(asked["since"])
                self._say(200, json.dumps([e for e in outer.log if e["position"] >= since][: int(asked["most"])]))

            def do_POST(self):  # noqa: N802
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                with outer.lock:
                    outer.posts.append(body)
                    how = body.get("how")
                    n = outer.seen[body.get("request_id")] = outer.seen.get(body.get("request_id"), 0) + 1
                if how == "busy" and n < 3:
                    self._say(503, "busy")
                elif how == "refused":
                    self._say(400, "no")
                elif how == "noise":
                    self._say(200, "<html>")
                else:
                    self._say(200, json.dumps({"output_text": f"hello {body.get('request_id')}", "usage": {"input_tokens": 3, "output_tokens": 2}}))

        self.http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.http.server_address[1]}/"


@pytest.fixture
def server(spark):
    remote.register(spark)
    s = Server()
    yield s
    s.http.shutdown()


HOW = [("a", None), ("b", "busy"), ("c", "refused"), ("d", "noise"), ("e", None)]


def test_a_model_is_read_in_partitions_with_retries(spark, server):
    asked = json.dumps([{"request_id": i, "how": h} for i, h in HOW])
    df = spark.read.format("model_replies").option("url", server.url).option("requests", asked).option("partitions", 2).option("pause", 0.01).load()
    assert df.rdd.getNumPartitions() == 2
    got = {r["request_id"]: r for r in df.collect()}
    assert {i: (r["status"], r["attempts"], r["text"]) for i, r in got.items()} == {"a": (200, 1, "hello a"), "b": (200, 3, "hello b"), "c": (400, 1, None), "d": (200, 1, None), "e": (200, 1, "hello e")}
    assert got["c"]["error"] == "status 400" and got["d"]["error"].startswith("bad reply") and got["a"]["input_tokens"] == 3
    with pytest.raises(Exception, match="needs the option url"):
        spark.read.format("model_replies").load().collect()
    gone = spark.read.format("model_replies").option("url", "http://127.0.0.1:9/").option("requests", "[{}]").option("retries", 1).option("pause", 0.01).load().first()
    assert gone["status"] is None and gone["attempts"] == 2 and gone["error"].startswith("unreachable")


def test_a_table_of_requests_is_asked_and_traced(spark, server, tmp_path):
    rows = spark.createDataFrame([(i, json.dumps({"request_id": i, "how": h})) for i, h in HOW] + [("f", "{no"), ("g", None)], "request_id string, body string").repartition(3)
    tracer = tracing.Tracer((1.0, 2.0))
    tracer.step("ask", remote.ask(rows, server.url, pause=0.01), lambda f: f.write.parquet(str(tmp_path / "replies")), "hash-1")
    kept = spark.read.parquet(str(tmp_path / "replies")).collect()
    assert len(server.posts) == 7  # five requests, one of them three times: nothing was asked again for the trace
    (step,) = tracer.steps
    assert (step["rows"], step["errors"], step["input_tokens"], step["output_tokens"]) == (7, 4, sum(r["input_tokens"] for r in kept), sum(r["output_tokens"] for r in kept)) == (7, 4, 9, 6)
    assert step["model_ms"] == pytest.approx(sum(r["latency_ms"] for r in kept)) and step["cost_usd"] == pytest.approx((9 + 2 * 6) / 1e6) and step["wall_ms"] > 0
    row = tracer.table(spark).first()
    assert row["name"] == "ask" and row["prompt_hash"] == "hash-1" and row["rows"] == 7


def test_a_log_is_streamed_by_position_and_written(spark, server, tmp_path):
    def drain():
        q = spark.readStream.format("model_log").option("url", server.url).option("most", 3).load().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).start()
        try:
            for _ in range(100):
                q.processAllAvailable()
                if q.lastProgress and f"{len(server.log)}}}" in str(q.lastProgress["sources"][0]["endOffset"]):
                    return
                time.sleep(0.2)
        finally:
            q.stop()

    drain()
    server.log.append({"position": 7, "request_id": "late", "body": None})
    drain()
    got = sorted((r["position"], r["request_id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(e["position"], e["request_id"]) for e in server.log]
    spark.range(10).repartition(2).write.format("model_log").option("url", server.url).option("most", 2).option("job", "j").mode("append").save()
    posts = [p for p in server.posts if p.get("job") == "j"]
    assert sorted(e["id"] for p in posts for e in p.get("entries", ())) == list(range(10)) and posts[-1]["committed"] == 10
    assert len({p["key"] for p in posts if "key" in p}) == len(posts) - 1


# ---- table functions, typed JSON, tokens ---------------------------------------------------------


def test_a_callers_own_fold_runs_from_sql(spark):
    class Longest(tables.Fold):
        returns, partition_by, order_by = "call_id string, turn_index int, n int", ("call_id",), ("turn_index",)

        def __init__(self, least=0):
            self.least, self.best = least, None

        def add(self, row):
            assert self.best is None or row["turn_index"] > self.best["turn_index"] or len(row["text"]) <= len(self.best["text"])
            if len(row["text"]) >= self.least and (self.best is None or len(row["text"]) > len(self.best["text"])):
                self.best = row
            return ()

        def end(self):
            if self.best is not None:
                yield self.best["call_id"], self.best["turn_index"], len(self.best["text"])

    tables.register(spark, "longest_turn", Longest)
    turns = spark.createDataFrame([("a", 2, "x" * 9), ("a", 1, "x" * 3), ("b", 1, "x"), ("b", 2, "xx"), ("c", 1, "")], "call_id string, turn_index int, text string").repartition(4)
    assert sorted(map(tuple, spark.sql("SELECT * FROM longest_turn(TABLE({t}), 2)", t=turns).collect())) == [("a", 2, 9), ("b", 2, 2)]
    with pytest.raises(Exception, match="needs the columns"):
        spark.sql("SELECT * FROM longest_turn(TABLE({t}))", t=turns.drop("turn_index"))
    assert spark.sql("SELECT * FROM longest_turn(TABLE({t}))", t=turns.limit(0)).collect() == []


def test_values_keep_the_type_they_came_with(spark, tmp_path):
    lines = ['{"deal": 10, "n": [1, "a"]}', '{"deal": "10"}', "", '{"deal": true, "n": {"x": null}}', "{broken", '{"deal": null}', '{"deal": 1e3}']
    (tmp_path / "in.jsonl").write_text("\n".join(lines))
    rows = variants.read_jsonl(spark, str(tmp_path / "in.jsonl"))
    typed = variants.silver_rows(rows, "value", {"deal": "$.deal", "n": "$.n"}, ("broken",))
    got = sorted((r["broken"] or "", r["deal"]["kind"], r["deal"]["number"], r["deal"]["string"], r["n"]["kind"], r["n"]["json"]) for r in typed.collect())
    assert got == sorted([("", "number", 10.0, None, "array", '[1,"a"]'), ("", "string", None, "10", "missing", None), ("", "boolean", None, None, "object", '{"x":null}'), ("{broken", "missing", None, None, "missing", None), ("", "null", None, None, "missing", None), ("", "number", 1000.0, None, "missing", None)], key=lambda r: r)
    matched = lambda op, v: typed.where(variants.compared("deal", op, v)).count()
    assert [matched(">=", 10), matched("==", "10"), matched("==", True), matched("!=", "x"), matched("<", 1000)] == [2, 1, 1, 1, 1]
    assert "VARIANT" in variants.schema_of(rows.where("value is not null"), "value")
    with pytest.raises(ValueError):
        variants.compared("deal", "~", 1)


def test_scripts_without_spaces_are_found(spark, tmp_path):
    docs = spark.createDataFrame([(1, "東京の天気は晴れです"), (2, "京都の天気 report"), (3, "Customer's report of the weather"), (4, "価格が高い。更新しない"), (5, "漢" * 3000)], "chunk_id long, bm25_text string")
    q = spark.createDataFrame([(0, "東京"), (1, "天気 report"), (2, "更新"), (3, "weather")], "query_id int, query string")
    found = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in df.collect())
    got = found(retrieval.bm25(docs, q, 5, tokens=tx.script_tokens))
    assert got[:1] + got[4:] == [(0, 1, 1), (2, 1, 4), (3, 1, 3)] and got[1] == (1, 1, 2) and {c for _, _, c in got[2:4]} == {1, 3}
    index = SearchIndex(spark, str(tmp_path))
    index.add(docs, "one", tokens=tx.script_tokens)
    assert found(index.search(q, 5, tokens=tx.script_tokens)) == got
    latin = spark.createDataFrame([("Don't the customers' boss's a_b X 1st calls ünder",), ("it's o's",), ("",), (None,)], "t string")
    assert all(r[0] == r[1] for r in latin.select(tx.script_tokens("t"), tx.english_tokens("t")).collect())


def test_small_text_rules(spark):
    row = spark.createDataFrame([("Which (pricing/refund) calls, re-new_all x7? The pricing!", None, " ", "  two\n words ")], "q string, a string, b string, c string")
    assert row.select(tx.suggested_values("q"), tx.first_text("a", "b", "c"), tx.choice("c", ("x",), "none"), tx.choice(F.lit(" Manual "), ("manual",), "none")).first()[:] == (["pricing", "refund", "new_all"], "two words", "none", "manual")


def test_terms_are_found_in_very_long_tasks(spark):
    words = " ".join(f"w{k % 7000}x" for k in range(20_000))
    tasks = spark.createDataFrame([(k, f"{words} deal{k}") for k in range(4)] + [(9, "Renewal RISK"), (9, "Renewal RISK"), (10, None), (None, "renewal"), (11, "")], "ordinal long, query string").repartition(4)
    wanted = spark.createDataFrame([("a", ["deal2", "zz"]), ("b", ["w6999x", "renewal"]), ("c", ["unheard", None]), ("d", []), ("a", ["deal3"])], "field_name string, terms array<string>")
    began = time.monotonic()
    got = {r["field_name"]: r["tasks"] for r in negotiation.matching_tasks(wanted, tasks, 6).collect()}
    assert got == {"a": [2, 3], "b": [0, 1, 2, 3, 9]} and time.monotonic() - began < 40


def test_terms_are_not_looked_for_in_every_task(spark):
    # 4,000 terms begin as these texts' words do: looked for in each text they weren't through after two minutes
    tasks = spark.range(400).repartition(4).select(F.col("id").alias("ordinal"), F.concat(F.repeat(F.lit("abcdefgh ijk abc "), 4700), F.lit(" Term"), F.col("id").cast("string")).alias("query"))
    words = spark.range(4000).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("field_name"), F.array(F.concat(F.lit("abcx"), F.col("id").cast("string")), F.concat(F.lit("erm"), F.col("id").cast("string"))).alias("terms"))
    began = time.monotonic()
    got = {r["field_name"]: r["tasks"] for r in negotiation.matching_tasks(words, tasks, 3).collect()}
    assert got == {f"f{i}": [k for k in range(400) if f"term{k}".find(f"erm{i}") >= 0][:3] for i in range(400)} and time.monotonic() - began < 60


def test_terms_across_stretches_of_a_long_run(spark):
    run = "".join(chr(97 + k * k % 23) for k in range(5000))
    texts = {k: run[k:] for k in (0, 1, 63, 64, 65)} | {7: "É" + "ab c" * 9 + "ßé", 8: "ab"}
    terms = [run[k : k + n] for k in (0, 55, 63, 64, 1000, 4990) for n in (3, 5, 6, 7, 64, 90)] + ["éab", "b ca", "cßé", "zzz", "a" * 200]
    wanted = spark.createDataFrame([(t, [t]) for t in {*terms}], "field_name string, terms array<string>")
    got = {r["field_name"]: r["tasks"] for r in negotiation.matching_tasks(wanted, spark.createDataFrame([*texts.items()], "ordinal long, query string"), 4).collect()}
    assert got == {t: found for t in terms if (found := [k for k in sorted(texts) if t in texts[k].lower()][:4])}
