"""Bounded batches of calls with a check between them, resumable: a batch is one tagged job whose result is written before its row in the ledger, so what was
asked of a model isn't asked again.

Below the root: ``plan`` (which call is in which batch, fixed when the run begins), ``out/batch=k`` (its rows) and ``ledger/batch=k`` (its figures, written last)."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.shared import children, exists


@dataclass
class Batches:
    """A run over ``calls`` (call_id, ordinal, ...) in batches of ``size`` in the order of ``ordinal``. ``work`` gives a batch's rows, without an order of its own; ``figures`` are aggregates
    over them that the job itself observes as it writes. ``check`` sees every batch's figures and the totals so far, and returns why to stop, or None.

    A run that was stopped, or lost, goes on with the first batch that the ledger doesn't have when ``run`` is called again."""

    spark: SparkSession
    root: str
    calls: DataFrame
    work: Callable[[DataFrame], DataFrame]
    size: int = 100
    figures: dict[str, Column] = field(default_factory=dict)
    check: Callable[[dict[str, Any], dict[str, Any]], str | None] = lambda batch, total: None
    max_seconds: float | None = None

    @property
    def tag(self) -> str:
        return f"batches-{abs(hash(self.root)):x}"

    def plan(self) -> DataFrame:
        """(call_id, ordinal, batch). Places are counted within ranges of ``ordinal`` and shifted by the sizes of the ranges before: no task sees all calls. Written once, as a
        later run must find the same batches."""
        at = f"{self.root}/plan"
        if not exists(self.spark, f"{at}/_SUCCESS"):
            ranged = f"{self.root}/ranged"
            kept = self.calls.where(F.col("call_id").isNotNull()).select("call_id", "ordinal")
            kept.repartitionByRange("ordinal", "call_id").withColumn("part", F.spark_partition_id()).write.mode("overwrite").parquet(ranged)
            rows = self.spark.read.parquet(ranged)
            before, starts = 0, []
            for r in rows.groupBy("part").count().orderBy("part").collect():
                starts.append((r["part"], before))
                before += r["count"]
            start = F.broadcast(self.spark.createDataFrame(starts, "part int, start long"))
            place = F.expr("row_number() over (partition by part order by ordinal, call_id)") - 1 + F.col("start")
            rows.join(start, "part").select("call_id", "ordinal", F.floor(place / self.size).cast("int").alias("batch")).write.mode("overwrite").parquet(at)
        return self.spark.read.parquet(at)

    def ledger(self) -> list[dict[str, Any]]:
        """Figures of the committed batches, by number."""
        names = [n for n in children(self.spark, f"{self.root}/ledger") if n.startswith("batch=") and exists(self.spark, f"{self.root}/ledger/{n}/_SUCCESS")]
        rows = self.spark.read.text([f"{self.root}/ledger/{n}" for n in names]).collect() if names else []
        return sorted((json.loads(r["value"]) for r in rows), key=lambda r: r["batch"])

    def _one(self, k: int, plan: DataFrame) -> dict[str, Any]:
        context, tag = self.spark.sparkContext, f"{self.tag}-{k}"
        seen = Observation(f"batch {k}")
        own = plan.where(F.col("batch") == k).select("call_id")
        # a batch is bounded by its size, so its ids may be broadcast
        rows = self.work(self.calls.join(F.broadcast(own), "call_id", "left_semi"))
        rows = rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in self.figures.items()])
        timer = threading.Timer(self.max_seconds, lambda: context.cancelJobsWithTag(tag)) if self.max_seconds else None
        context.addJobTag(tag)
        try:
            if timer:
                timer.start()
            rows.write.mode("overwrite").parquet(f"{self.root}/out/batch={k}")
        finally:
            context.removeJobTag(tag)
            if timer:
                timer.cancel()
        told = {"batch": k} | seen.get
        self.spark.createDataFrame([(json.dumps(told, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/ledger/batch={k}")
        return told

    def run(self) -> dict[str, Any]:
        """Does what is left; {batches, done, stopped, totals}. A batch that takes more than ``max_seconds`` is cancelled, and an error, with those before it kept."""
        plan = self.plan()
        last = plan.agg(F.max("batch")).first()[0]
        done = {r["batch"]: r for r in self.ledger()}
        why = None
        for k in range(0 if last is None else last + 1):
            if k in done:
                continue
            done[k] = self._one(k, plan)
            if why := self.check(done[k], self.totals(done.values())):
                break
        return {"batches": 0 if last is None else last + 1, "done": len(done), "stopped": why, "totals": self.totals(done.values())}

    @staticmethod
    def totals(rows: Any) -> dict[str, Any]:
        out: dict[str, Any] = {}
        for r in rows:
            for k, v in r.items():
                if k != "batch" and isinstance(v, (int, float)):
                    out[k] = out.get(k, 0) + v
        return out

    def result(self) -> DataFrame:
        """The rows of the committed batches, with ``batch``: what a batch wrote before it was lost isn't among them."""
        parts = [f"{self.root}/out/batch={r['batch']}" for r in self.ledger()]
        if not parts:
            raise ValueError("no batch is done")
        return self.spark.read.option("basePath", f"{self.root}/out").parquet(*parts)
