"""Centroid clustering in exact whole numbers, screened in float32.

A float32 matrix product gives the squared distance to every centroid up to a proven bound on its rounding. Only centroids whose
interval reaches below the least upper end can be nearest; where that leaves one, it is the nearest, and where intervals
overlap, those few are compared again in exact integers, the lowest number winning a tie. Assignments, and so the whole run,
don't hang on the order of sums, the number of tasks or the library behind the product.

A round is one pass: every task adds up its vectors by centroid, and only totals are shuffled and brought to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeing, sized, stash, unstash
from .whole_vectors import ROWS, first_distinct, floored, matrix, moved, summed, tally

#: Float32 products held at a time.
CELLS = 4_000_000


def _shortlist(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Which centroids may be nearest, per row. With u the unit roundoff of float32, a product of n terms is off by at most
    g = (n + 2) u / (1 - (n + 2) u) times the norms, in whatever order it is summed; the two more terms are for entries that
    float32 can't hold. What double precision adds is some 2**-50 of what it holds."""
    n, u = x.shape[1], 2.0**-24
    g = (n + 2) * u / (1 - (n + 2) * u)
    dot = (x.astype(np.float32) @ centers.astype(np.float32).T).astype(np.float64)
    squares = (centers * centers).sum(1).astype(np.float64)
    wide = x.astype(np.float64)
    norms = np.sqrt((wide * wide).sum(1))[:, None] * np.sqrt(squares)[None, :]
    about = squares[None, :] - 2 * dot  # less the row's own square, the same for all centroids
    off = 2 * g * norms * (1 + 2.0**-40) + 2.0**-48 * (squares[None, :] + 2 * np.abs(dot) + norms)
    return about - off <= (about + off).min(1)[:, None]


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The number of the nearest centroid to each row, the lowest of equally near ones."""
    out = np.empty(len(x), np.int64)
    step = max(1, CELLS // len(centers))
    for lo in range(0, len(x), step):
        some = x[lo : lo + step]
        may = _shortlist(some, centers)
        at = may.argmax(1)
        rows, cols = np.nonzero(may[open_ := np.flatnonzero(may.sum(1) > 1)])
        if len(open_):
            exact = np.empty(len(rows), np.int64)
            for k in range(0, len(rows), step):
                diff = some[open_[rows[k : k + step]]].astype(np.int64) - centers[cols[k : k + step]]
                exact[k : k + step] = (diff * diff).sum(1)
            start = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
            least = np.minimum.reduceat(exact, start)
            hit = np.flatnonzero(exact == np.repeat(least, np.diff(np.append(start, len(rows)))))
            first = hit[np.unique(rows[hit], return_index=True)[1]]
            at[open_] = cols[first]
        out[lo : lo + step] = at
    return out


def _assigned(centers: np.ndarray, digests: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("q"), centers.shape[1])
            at = nearest(x, centers)
            diff = x.astype(np.int64) - centers[at]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(at, pa.int32()), pa.array((diff * diff).sum(1), pa.int64()), pa.array([digests[c] for c in at], pa.string())], ["id", "cluster", "distance", "centroid_sha256"])

    return run


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: str = "3", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row per row with a vector of ``dim`` finite components.

    Components become floor(scale * x). The centroids start as the vectors of the ``k`` ids whose sha256 of ``seed:id`` is least, move
    ``rounds`` times to the floor of their vectors' mean (one that no vector is nearest to stays), and every vector is assigned once more.
    Null vectors, vectors of another length and those with null, NaN or infinite components are left out. Rows that repeat an
    id are vectors of their own (where they differ, the one with the least bytes may start a centroid); rows without an id are
    assigned but start none. With fewer than ``k`` ids there are fewer centroids; with none, no rows. Components
    beyond +-``whole_vectors.largest(dim)`` after scaling are an error. Extra columns are ignored."""
    ids = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    whole = floored(ids, scale, "v", ["id"]).where(F.col("dim") == dim)
    kept = stash(whole.select("id", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("drawn"), "q"))
    centers = first_distinct(kept, "drawn", k, dim)
    if not len(centers):
        return kept.select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256")).limit(0)

    for _ in range(rounds):

        def sums(blocks: Iterator[np.ndarray], centers: np.ndarray = centers) -> np.ndarray:
            out = np.zeros(centers.size + len(centers), np.int64)
            for x in blocks:
                out += tally(nearest(x, centers), x, len(centers))
            return out

        centers = moved(centers, summed(kept, sums, dim))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers.tolist()]
    kind = kept.schema["id"].dataType.simpleString()
    found = stash(kept.select("id", "q").mapInArrow(freeing(_assigned(centers, digests), ROWS), f"id {kind}, cluster int, distance long, centroid_sha256 string"))
    unstash(kept)
    inertia = stash(found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")))
    whole_inertia = F.lit(inertia.agg(F.sum("cluster_inertia")).first()[0]).cast("long").alias("inertia")
    return found.join(sized(inertia), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", whole_inertia, "centroid_sha256")
