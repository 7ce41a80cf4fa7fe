"""Vectors as whole numbers, for operators whose results must not hang on rounding or on the order of sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeing

#: Rows that a task works on at a time.
ROWS = 10_000


def largest(dim: int) -> int:
    """The largest component for which any squared distance fits 63 bits."""
    return isqrt((1 << 62) // (4 * dim)) - 1


def _floored(scale: int, carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            length = pc.fill_null(pc.list_value_length(v), 0).to_numpy().astype(np.int64)
            flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null entries become NaN
            start = np.cumsum(length) - length
            for dim in np.unique(length[length > 0]).tolist():
                at = np.flatnonzero(length == dim)
                x = flat[start[at][:, None] + np.arange(dim)]
                good = np.isfinite(x).all(1)
                at, x = at[good], np.floor(scale * x[good])
                if len(at) and np.abs(x).max() > largest(dim):
                    raise ValueError(f"a component of {np.abs(x).max():.4g} after scaling is beyond {largest(dim)}: scale the vectors down")
                raw = [r.tobytes() for r in x.astype("<i4")]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(at)) for c in carried], pa.array(np.full(len(at), dim, np.int32)), pa.array(raw, pa.binary())], [*carried, "dim", "q"])

    return run


def floored(vectors: DataFrame, scale: int, vector_col: str, carried: list[str]) -> DataFrame:
    """(carried..., dim, q): q holds floor(scale * x) of every component as four little-endian bytes. Rows whose vector is null, empty
    or holds null or non-finite components are left out; a component too large for exact distances is an error."""
    src = vectors.select(*carried, F.col(vector_col).cast("array<double>").alias("v"))
    out = vectors.select(*carried).schema.add("dim", "integer").add("q", "binary")
    return src.mapInArrow(freeing(_floored(scale, carried), ROWS), out)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The rows' numbers, one row each."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dim)


def first_distinct(kept: DataFrame, order: str, n: int, dim: int) -> np.ndarray:
    """The vectors of the ``n`` least values of ``order`` (of rows that share one, the vector with the least bytes); fewer where there are fewer.
    Every pass takes the top ``n`` rows, and there are more passes only where rows repeat a value."""
    found: dict = {}
    rest = kept.where(F.col(order).isNotNull()).select(order, "q")
    while len(found) < n:
        top = rest.orderBy(order, "q").limit(n).collect()
        for r in top:
            if len(found) < n:
                found.setdefault(r[order], bytes(r["q"]))
        if len(top) < n:
            break
        rest = rest.where(F.col(order) > F.lit(top[-1][order]))
    return np.frombuffer(b"".join(found.values()), "<i4").reshape(-1, dim).astype(np.int64)


def summed(kept: DataFrame, sums: Callable[[Iterator[np.ndarray]], np.ndarray], dim: int) -> dict[int, int]:
    """Exact totals over all rows: ``sums`` gives one vector of totals per task, and tasks' totals are added up by slot.
    What returns to the driver is one number a slot, however many rows there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sums(matrix(b.column("q"), dim) for b in batches if b.num_rows)
        slots = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(total[slots], pa.int64())], ["slot", "total"])

    slots = kept.select("q").mapInArrow(freeing(run, ROWS), "slot long, total long")
    return {r["slot"]: int(r["total"]) for r in slots.groupBy("slot").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}


def moved(centers: np.ndarray, totals: dict[int, int]) -> np.ndarray:
    """Each row of ``centers`` becomes floor(sum / count) of what was assigned to it; a row that nothing was assigned to stays. Slots are
    row * (dim + 1) + position, the last position holding the count."""
    out = centers.copy()
    width = centers.shape[1] + 1
    for c in range(len(centers)):
        n = totals.get(c * width + width - 1, 0)
        if n:
            out[c] = [totals.get(c * width + p, 0) // n for p in range(width - 1)]
    return out


def tally(at: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Per slot as in ``moved``, the sums and counts of rows ``x`` assigned to ``at``."""
    out = np.zeros((k, x.shape[1] + 1), np.int64)
    order = np.argsort(at, kind="stable")
    some, start = np.unique(at[order], return_index=True)
    if len(some):
        out[some, :-1] = np.add.reduceat(x[order], start, axis=0, dtype=np.int64)
        out[some, -1] = np.diff(np.append(start, len(at)))
    return out.ravel()
