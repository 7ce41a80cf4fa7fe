"""Vectors compressed to codes: every vector is cut into equal parts, and each part is replaced by the number of the nearest entry of its
position's codebook, all in exact whole numbers.

The entries of a position stand in a vantage-point tree: a node splits the rest by their distance to one entry and keeps, for the
inner and the outer half, the least and the greatest distance. By the triangle inequality a half whose range is farther from
the searched part than the best entry so far can't hold a nearer one. Radii and distances are square roots, which whole numbers bound: lower
ends are rounded down and upper ends up, a half is visited unless its bound is strictly greater, and what decides between entries is
the exact squared distance and then the lower index. So the tree gives just what comparing all entries gives.

A round is one pass: tasks add up parts by entry, and only totals are shuffled and brought to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeing, join_known, stash, unstash
from .whole_vectors import ROWS, first_distinct, floored, matrix, moved, summed, tally

#: So few entries are compared one by one.
LEAF = 2


@dataclass(frozen=True)
class Half:
    """Entries at a distance of ``low`` to ``high`` from the vantage point above, both rounded outwards."""

    low: int
    high: int
    node: Node


@dataclass(frozen=True)
class Node:
    """Entries to compare one by one, the vantage point alone if there are halves below it."""

    entries: tuple[int, ...]
    halves: tuple[Half, ...] = ()


def tree(entries: np.ndarray, some: list[int] | None = None) -> Node:
    """A vantage-point tree over the rows of ``entries``. The vantage point is the entry farthest from the first one."""
    some = list(range(len(entries))) if some is None else some
    if len(some) <= LEAF:
        return Node(tuple(some))
    spread = ((entries[some] - entries[some[0]]) ** 2).sum(1)
    top = some[int(spread.argmax())]
    rest = [e for e in some if e != top]
    square = ((entries[rest] - entries[top]) ** 2).sum(1)
    order = np.argsort(square, kind="stable")
    cut = len(rest) // 2

    def half(part: np.ndarray) -> Half:
        low, high = int(square[part[0]]), int(square[part[-1]])
        return Half(isqrt(low), isqrt(high - 1) + 1 if high else 0, tree(entries, sorted(rest[p] for p in part)))

    return Node((top,), (half(order[:cut]), half(order[cut:])))


class Search:
    """The nearest entries to the rows of ``points``: ``at`` (lowest index of equally near ones) and ``square``, exact. Rows go down
    the tree together, each only where its own bound lets it."""

    def __init__(self, root: Node, entries: np.ndarray, points: np.ndarray):
        self.entries, self.points = entries, points
        self.at = np.full(len(points), len(entries), np.int64)
        self.square = np.full(len(points), np.iinfo(np.int64).max)
        self.compared = 0
        self._visit(root, np.arange(len(points)))

    def _compare(self, entry: int, rows: np.ndarray) -> np.ndarray:
        diff = self.points[rows] - self.entries[entry]
        square = np.einsum("ij,ij->i", diff, diff)
        self.compared += len(rows)
        best = self.square[rows]
        better = (square < best) | ((square == best) & (entry < self.at[rows]))
        self.at[rows[better]], self.square[rows[better]] = entry, square[better]
        return square

    def _visit(self, node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        for e in node.entries:
            square = self._compare(e, rows)
        if not node.halves:
            return
        root = np.floor(np.sqrt(square.astype(np.float64))).astype(np.int64)
        low, high = np.maximum(root - 1, 0), root + 2  # whatever way the square root was rounded
        inner, outer = node.halves
        inside = root <= (inner.high + outer.low) // 2
        for first, second, side in ((inner, outer, inside), (outer, inner, ~inside)):
            for half in (first, second):
                gap = np.maximum(np.maximum(half.low - high[side], low[side] - half.high), 0)
                self._visit(half.node, rows[side][gap * gap <= self.square[rows[side]]])


def _parts(x: np.ndarray, books: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    size = books[0].shape[1]
    for p in range(len(books)):
        yield p, x[:, p * size : (p + 1) * size].astype(np.int64)


def _coded(books: list[np.ndarray], trees: list[Node], carried: list[str]):
    digits = [f"{i:0{max(2, len(f'{len(books[0]) - 1:x}'))}x}" for i in range(len(books[0]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("q"), books[0].size // len(books[0]) * len(books))
            found = [Search(trees[p], books[p], part) for p, part in _parts(x, books)]
            codes = ["".join(map(digits.__getitem__, row)) for row in np.stack([f.at for f in found], 1).tolist()]
            error = np.sum([f.square for f in found], axis=0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carried], pa.array(codes, pa.string()), pa.array(error, pa.int64())], [*carried, "code", "error"])

    return run


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id_col, label_col, code, error, label_error, codebooks_sha256), one row per row with a vector of finite components.

    Components become floor(scale * x). A position's codebook starts as that part of the vectors of the ``entries`` smallest ids, its entries move
    ``rounds`` times to the floor of their parts' mean (one that no part is nearest to stays), and all parts are assigned once more. error
    sums the squared distances of a vector's parts, label_error the errors of all rows of a label, rows without one together.

    Null and empty vectors and those with null, NaN or infinite components are left out, and so are vectors of
    another length than most have (of equally frequent lengths the greatest), as they can't be cut alike; a length that ``parts`` doesn't divide is an error, and so are
    components beyond +-``whole_vectors.largest`` after scaling. Rows that repeat an id are vectors of their own (where they differ, the one with the least bytes may start an
    entry); rows without an id are coded but start none. With fewer ids than ``entries`` the codebooks are smaller; with none there are no
    rows. Extra columns are ignored."""
    src = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    whole = stash(floored(src, scale, "v", ["id", "label"]))
    most = whole.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = most["dim"] if most else parts
    if dim % parts:
        raise ValueError(f"vectors of {dim} components can't be cut into {parts} equal parts")
    kept = whole.where(F.col("dim") == dim)
    size = dim // parts
    start = first_distinct(kept, "id", entries, dim)
    if not len(start):
        none = [F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")]
        return kept.select(F.col("id").alias(id_col), F.col("label").alias(label_col), *none).limit(0)
    books = [start[:, p * size : (p + 1) * size] for p in range(parts)]
    slots = len(start) * (size + 1)
    for _ in range(rounds):

        def sums(blocks: Iterator[np.ndarray], books: list[np.ndarray] = books, trees: list[Node] = [tree(b) for b in books]) -> np.ndarray:
            out = np.zeros(parts * slots, np.int64)
            for x in blocks:
                for p, part in _parts(x, books):
                    out[p * slots : (p + 1) * slots] += tally(Search(trees[p], books[p], part).at, part, len(books[p]))
            return out

        totals = summed(kept, sums, dim)
        books = [moved(b, {s - p * slots: t for s, t in totals.items() if p * slots <= s < (p + 1) * slots}) for p, b in enumerate(books)]
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    carried = kept.select("id", "label").schema.add("code", "string").add("error", "long")
    found = stash(kept.select("id", "label", "q").mapInArrow(freeing(_coded(books, [tree(b) for b in books], ["id", "label"]), ROWS), carried))
    unstash(whole)
    told = found.withColumn("named", F.concat(F.when(F.col("label").isNull(), "0").otherwise("1"), F.coalesce(F.col("label").cast("string"), F.lit(""))))
    totals = stash(told.groupBy("named").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("copies")))
    out = join_known(told, totals, "named", "copies")
    return out.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
