"""What a step did, told by the job that did it: figures that executors observe while rows pass, without a second pass over them."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

TRACE = "step int, name string, prompt_hash string, rows long, input_tokens long, output_tokens long, errors long, model_ms double, wall_ms double, cost_usd double"


def _sum(df: DataFrame, column: str, kind: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast(kind) if column in df.columns else F.lit(0).cast(kind)


@dataclass
class Tracer:
    """A list of steps. ``step`` runs an action over a frame and notes how many rows passed, and of columns input_tokens, output_tokens, latency_ms and error or validation_errors, where the frame
    has them, the sums. ``rates`` are USD per million tokens."""

    rates: tuple[float, float] | None = None
    steps: list[dict[str, Any]] = field(default_factory=list)

    def step(self, name: str, frame: DataFrame, act: Callable[[DataFrame], Any], prompt_hash: str | None = None) -> Any:
        from siltstone.plans.usage import cost_of

        seen = Observation(f"step {len(self.steps) + 1}")
        wrong = F.col("error").isNotNull() if "error" in frame.columns else F.size("validation_errors") > 0 if "validation_errors" in frame.columns else F.lit(False)
        told = frame.observe(seen, F.count(F.lit(1)).alias("rows"), _sum(frame, "input_tokens", "long").alias("input_tokens"), _sum(frame, "output_tokens", "long").alias("output_tokens"), F.count_if(wrong).alias("errors"), _sum(frame, "latency_ms", "double").alias("model_ms"))
        began = time.perf_counter()
        out = act(told)
        took = round(1000 * (time.perf_counter() - began), 3)
        got = seen.get
        self.steps.append({"step": len(self.steps) + 1, "name": name, "prompt_hash": prompt_hash, **got, "wall_ms": took, "cost_usd": cost_of(got["input_tokens"], got["output_tokens"], self.rates)})
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """One row a step; the driver holds no more than these."""
        return spark.createDataFrame([tuple(s[c.split()[0]] for c in TRACE.split(", ")) for s in self.steps], TRACE)
