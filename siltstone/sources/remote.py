"""Remote models and their logs as Spark sources and sinks, through Python data sources: ``spark.read.format("model_replies")``, ``spark.readStream.format("model_log")`` and
``df.write.format("model_log")``. Plain HTTP with the standard library; requests go out from the executors."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, SimpleDataSourceStreamReader, WriterCommitMessage

REPLY = "request_id string, status int, attempts int, latency_ms double, input_tokens long, output_tokens long, text string, error string"
LOG = "position long, request_id string, body string"
#: Replies that are worth another try.
AGAIN = (408, 409, 425, 429, 500, 502, 503, 504)


def post(url: str, body: Any, timeout: float, retries: int, pause: float = 0.2) -> tuple[int | None, int, str]:
    """(status, attempts, text): what is worth another try is tried again, each time after twice the pause. A server that can't be reached has no status and its fault as the text."""
    data = json.dumps(body, ensure_ascii=False).encode()
    for attempt in range(1, retries + 2):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, data, {"Content-Type": "application/json"}), timeout=timeout) as reply:
                return reply.status, attempt, reply.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            got = (e.code, attempt, e.read().decode("utf-8", "replace"))
            if e.code not in AGAIN or attempt > retries:
                return got
        except (urllib.error.URLError, OSError) as e:
            got = (None, attempt, f"{type(e).__name__}: {e}")
            if attempt > retries:
                return got
        time.sleep(pause * 2 ** (attempt - 1))
    raise AssertionError("unreachable")


def asked(url: str, request_id: str, body: Any, timeout: float, retries: int, pause: float = 0.2) -> tuple:
    """One row of ``REPLY``. Whatever a server says is a row: a reply that is no JSON, or without a text, has an error and no text."""
    from siltstone.plans.model import response_text
    from siltstone.plans.usage import parse_usage

    began = time.perf_counter()
    status, attempts, said = post(url, body, timeout, retries, pause)
    took = round(1000 * (time.perf_counter() - began), 3)
    usage, text, error = (0, 0), None, None
    if status is None:
        error = f"unreachable: {said}"
    elif status >= 400:
        error = f"status {status}"
    else:
        try:
            reply = json.loads(said)
            usage = parse_usage(reply)
            text = response_text(reply)
        except ValueError as e:
            error = f"bad reply: {e}"
    return request_id, status, attempts, took, usage[0], usage[1], text, error


def ask(requests: DataFrame, url: str, timeout: float = 60, retries: int = 2, pause: float = 0.2) -> DataFrame:
    """requests (request_id, body as JSON text) -> rows of ``REPLY``: for tables of any size, a request each, from the tasks that hold them. A body that is no JSON is a row with an
    error, and isn't sent. Write the result before it is read twice: every reading asks again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    got = asked(url, row["request_id"], json.loads(row["body"] or ""), timeout, retries, pause)
                except ValueError as e:
                    got = (row["request_id"], None, 0, 0.0, 0, 0, None, f"bad request: {e}")
                yield pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, got))], schema=_ARROW)

    return requests.select(F.col("request_id").cast("string"), F.col("body").cast("string")).mapInArrow(run, REPLY)


_ARROW = pa.schema([("request_id", pa.string()), ("status", pa.int32()), ("attempts", pa.int32()), ("latency_ms", pa.float64()), ("input_tokens", pa.int64()), ("output_tokens", pa.int64()), ("text", pa.string()), ("error", pa.string())])


@dataclass
class Some(InputPartition):
    """Requests, or places of a log, that one task takes."""

    items: list[Any]

    def __init__(self, items: list[Any]):
        super().__init__(None)
        self.items = items


class _Replies(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.url, self.requests = options["url"], json.loads(options["requests"])
        self.timeout, self.retries, self.pause = float(options.get("timeout", 60)), int(options.get("retries", 2)), float(options.get("pause", 0.2))
        self.parts = max(1, int(options.get("partitions", 1)))

    def partitions(self) -> list[Some]:
        told = [(str(r.get("request_id", k)), r) for k, r in enumerate(self.requests)]
        return [Some(told[k :: self.parts]) for k in range(min(self.parts, len(told)))] or [Some([])]

    def read(self, partition: Some) -> Iterator[tuple]:
        for request_id, body in partition.items:
            yield asked(self.url, request_id, body, self.timeout, self.retries, self.pause)


class ModelReplies(DataSource):
    """``model_replies``: options url, requests (a JSON array of bodies, for the few that a driver makes up; tables go through ``ask``), partitions, retries, timeout, pause."""

    @classmethod
    def name(cls) -> str:
        return "model_replies"

    def schema(self) -> str:
        return REPLY

    def reader(self, schema: Any) -> DataSourceReader:
        for needed in ("url", "requests"):
            if needed not in self.options:
                raise ValueError(f"model_replies needs the option {needed}")
        return _Replies(dict(self.options))


def _log(url: str, since: int, most: int, timeout: float) -> list[dict[str, Any]]:
    with urllib.request.urlopen(f"{url}?since={since}&most={most}", timeout=timeout) as reply:
        return json.loads(reply.read())


def _rows(entries: list[dict[str, Any]]) -> Iterator[tuple]:
    return iter([(e["position"], e.get("request_id"), json.dumps(e.get("body"), ensure_ascii=False, sort_keys=True)) for e in entries])


class _LogStream(SimpleDataSourceStreamReader):
    """Offsets are positions of the log, so a batch that is run again reads the same entries."""

    def __init__(self, options: dict[str, str]):
        self.url, self.most, self.timeout = options["url"], int(options.get("most", 1000)), float(options.get("timeout", 60))

    def initialOffset(self) -> dict:
        return {"position": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        found = _log(self.url, start["position"], self.most, self.timeout)
        return _rows(found), {"position": max((e["position"] + 1 for e in found), default=start["position"])}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return _rows([e for e in _log(self.url, start["position"], end["position"] - start["position"], self.timeout) if e["position"] < end["position"]])


@dataclass
class _Sent(WriterCommitMessage):
    rows: int


class _LogWriter(DataSourceWriter):
    """Every task sends its rows in posts of ``most``, each with its partition and number as a key, so that a server can tell a task that runs again; the job ends with a post of the total."""

    def __init__(self, options: dict[str, str]):
        self.url, self.most, self.timeout, self.retries = options["url"], int(options.get("most", 1000)), float(options.get("timeout", 60)), int(options.get("retries", 2))
        self.job = options.get("job", "log")

    def _send(self, body: Any) -> None:
        status, _, said = post(self.url, body, self.timeout, self.retries)
        if status is None or status >= 300:
            raise RuntimeError(f"the log wasn't taken: {status} {said[:200]}")

    def write(self, rows: Iterator[Any]) -> WriterCommitMessage:
        from pyspark import TaskContext

        part, sent, held = TaskContext.get().partitionId(), 0, []

        def flush() -> None:
            self._send({"job": self.job, "key": f"{part}-{sent}", "entries": held})

        for row in rows:
            held.append(row.asDict(recursive=True))
            if len(held) == self.most:
                flush()
                sent, held = sent + len(held), []
        if held:
            flush()
        return _Sent(sent + len(held))

    def commit(self, messages: list[Any]) -> None:
        self._send({"job": self.job, "committed": sum(m.rows for m in messages if m)})

    def abort(self, messages: list[Any]) -> None:
        self._send({"job": self.job, "aborted": True})


class ModelLog(DataSource):
    """``model_log``: a stream of a server's request log (``url?since=position&most=n`` gives entries with position, request_id and body), and a sink that posts rows to it."""

    @classmethod
    def name(cls) -> str:
        return "model_log"

    def schema(self) -> str:
        return LOG

    def simpleStreamReader(self, schema: Any) -> SimpleDataSourceStreamReader:
        return _LogStream(dict(self.options))

    def writer(self, schema: Any, overwrite: bool) -> DataSourceWriter:
        return _LogWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ModelReplies)
    spark.dataSource.register(ModelLog)
