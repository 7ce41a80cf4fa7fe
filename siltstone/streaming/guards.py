"""Guardrails over a stream of run events: state per run, kept by Spark, with a timer for the time that a run may take."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENT = "run_id string, at timestamp, ok boolean, cost_usd double"
STOP = "run_id string, reason string, at timestamp, events long, errors int, cost_usd double"


class GuardProcessor(StatefulProcessor):
    """Per run: consecutive errors, USD, when it began, and the first reason to stop, which sticks. A run stops at ``max_errors`` errors in a row (0: any number), at
    ``max_usd``, or ``max_seconds`` after its first event, by whichever comes first in event time; if two come with one event, in this order. A run that falls silent is stopped by its timer, once the watermark
    passes that time."""

    def __init__(self, max_errors: int, max_usd: float | None, max_seconds: float | None):
        self.max_errors, self.max_usd, self.max_seconds = max_errors, max_usd, max_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", "events long, errors int, cost_usd double, began_ms long, reason string")

    def _stop(self, key: Any, reason: str, at_ms: int, events: int, errors: int, cost: float) -> pd.DataFrame:
        return pd.DataFrame({"run_id": [key[0]], "reason": [reason], "at": [pd.Timestamp(at_ms, unit="ms")], "events": [events], "errors": [errors], "cost_usd": [cost]})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        events, errors, cost, began, reason = self.state.get() if self.state.exists() else (0, 0, 0.0, None, None)
        got = pd.concat(list(rows)).sort_values("at", kind="stable")  # a run's events of one batch
        for r in got.itertuples():
            if reason:
                break
            now = int(r.at.timestamp() * 1000)
            if began is None:
                began = now
                if self.max_seconds is not None:
                    self.handle.registerTimer(began + int(self.max_seconds * 1000))
            late = self.max_seconds is not None and now - began >= self.max_seconds * 1000
            if late:  # the time was up before this event
                reason = "timeout"
                yield self._stop(key, reason, began + int(self.max_seconds * 1000), events, errors, cost)
                break
            events, errors, cost = events + 1, 0 if r.ok else errors + 1, cost + (0.0 if pd.isna(r.cost_usd) else float(r.cost_usd))
            reason = "max_errors" if 0 < self.max_errors <= errors else "budget" if self.max_usd is not None and round(cost, 10) >= self.max_usd else None
            if reason:
                yield self._stop(key, reason, now, events, errors, round(cost, 10))
        self.state.update((int(events), int(errors), float(cost), began, reason))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        events, errors, cost, began, reason = self.state.get()
        if not reason:
            self.state.update((events, errors, cost, began, "timeout"))
            yield self._stop(key, "timeout", began + int(self.max_seconds * 1000), events, errors, round(cost, 10))

    def close(self) -> None:
        pass


def stops(events: DataFrame, max_errors: int = 3, max_usd: float | None = None, max_seconds: float | None = None, late: str = "1 minute") -> DataFrame:
    """A stream of events (run_id, at, ok, cost_usd) -> one row per run that must stop. Needs RocksDB as the state store
    (``spark.sql.streaming.stateStore.providerClass``). Events without a run or a time are left out; one without a verdict counts as an error."""
    timed = events.where("run_id is not null and at is not null").withColumn("ok", F.coalesce("ok", F.lit(False))).withWatermark("at", late)
    return timed.groupBy("run_id").transformWithStateInPandas(GuardProcessor(max_errors, max_usd, max_seconds), STOP, "Append", "EventTime")
