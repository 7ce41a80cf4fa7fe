"""Embedding near-dedup by E8 lattice hashing.

In each of several tables a random projection takes a unit vector to eight dimensions, shifted and scaled;
its cell is the nearest point of the E8 lattice. A vector stands in its own cell and looks into the
neighbouring cells nearest to it; what meets in a cell is compared by
cosine in double precision, and only pairs that reach the threshold count.

Cells are narrow rows until it is known which hold company. Cells and components of any size are
compared in pairs of bounded blocks, and a block reports spanning links and counts, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_pairs, connected_components, forest, grouped, join_known, mix64, stash, unstash

TABLES, PROBES, WIDTH = 10, 6, 0.85
#: Vectors that a block of a group holds.
BLOCK = 1024


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or eight of +-1/2 with an even number of minus signs."""
    out = []
    for i in range(8):
        for j in range(i):
            for a, b in product((1, -1), repeat=2):
                v = np.zeros(8)
                v[i], v[j] = a, b
                out.append(v)
    out += [np.array(s) / 2 for s in product((1, -1), repeat=8) if s.count(-1) % 2 == 0]
    return np.array(out)


_NEAR = minimal_vectors()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Whole numbers with an even sum: where the sum is odd, the worst rounded one goes the other way."""
    r = np.rint(x)
    off = x - r
    odd = np.flatnonzero(r.sum(1) % 2)
    worst = np.abs(off[odd]).argmax(1)
    r[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest lattice point to each row: of the integer coset or the one shifted by halves."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def cells(unit: np.ndarray, tables: int, probes: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, own) of shape (n, tables * (1 + probes)): hashes of each vector's cells."""
    n, dim = unit.shape
    keys, own = [], []
    for t in range(tables):
        rng = np.random.default_rng((seed, dim, t))
        x = unit @ rng.normal(size=(dim, 8)) / width + rng.uniform(0, 2, 8)
        at = nearest_e8(x)
        toward = (x - at) @ _NEAR.T
        order = np.argsort(-toward, axis=1, kind="stable")[:, :probes]
        points = np.concatenate([at[:, None, :], at[:, None, :] + _NEAR[order]], axis=1)
        h = np.full(points.shape[:2], t * 1000003 + dim, np.uint64)
        for d in range(8):
            h = mix64(h + (2 * points[:, :, d]).astype(np.int64).view(np.uint64))
        keys.append(h)
        own.append(np.broadcast_to(np.arange(probes + 1) == 0, h.shape))
    return np.concatenate(keys, 1).view(np.int64), np.concatenate(own, 1)


def _units(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, unit vectors) of the rows that have a direction, by length of vector."""
    v = batch.column("v")
    length = pc.fill_null(pc.list_value_length(v), 0).to_numpy().astype(np.int64)
    flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null entries become NaN
    start = np.cumsum(length) - length
    ids = batch.column("id").to_numpy()
    for dim in np.unique(length[length > 0]).tolist():
        at = np.flatnonzero(length == dim)
        x = flat[start[at][:, None] + np.arange(dim)]
        good = np.isfinite(x).all(1) & x.any(1)
        x = x[good] / np.abs(x[good]).max(1)[:, None]
        if len(x):
            yield ids[at[good]], x / np.sqrt((x * x).sum(1))[:, None]


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, key, unit): equal unit vectors have equal keys, of 128 bits."""
    for batch in batches:
        for ids, unit in _units(batch):
            raw = [u.tobytes() for u in unit]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([xxhash.xxh3_128_digest(r) for r in raw], pa.binary()), pa.array(raw, pa.binary())], ["id", "key", "unit"])


def _hashed(tables: int, probes: int, width: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, raw = batch.column("key"), batch.column("unit")
            size = pc.binary_length(raw).to_numpy()
            for dim in np.unique(size).tolist():
                some = np.flatnonzero(size == dim)
                for lo in range(0, len(some), 2000):
                    part = some[lo : lo + 2000]
                    key, own = cells(np.array([np.frombuffer(raw[k].as_py()) for k in part]), tables, probes, width, seed)
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(np.repeat(part, key.shape[1]))), pa.array(key.ravel()), pa.array(own.ravel())], ["key", "cell", "own"])

    return run


def _linked(group: str, least: float, probing: bool):
    """Per pair of blocks, (a, b, links): a vector, the smallest it reaches, and how many rows it links with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in grouped(batches, [group, "i", "j"]):
            if g.num_rows < 2:
                continue
            blk, copies, raw = g.column("blk").to_numpy(), g.column("copies").to_numpy(), g.column("unit").to_pylist()
            # numbers in the keys' order stand for them here
            names, keys = np.unique(np.array(g.column("key").to_pylist(), object), return_inverse=True)
            apart = g.column("i")[0].as_py() != g.column("j")[0].as_py()
            own_of = g.column("own").to_numpy(zero_copy_only=False) if probing else None
            for size in {len(r) for r in raw}:  # vectors of different length only meet where hashes collide
                order = np.array([k for k in np.argsort(keys, kind="stable") if len(raw[k]) == size])
                x = np.array([np.frombuffer(raw[k]) for k in order])
                linked = x @ x.T >= least
                np.fill_diagonal(linked, False)
                if apart:
                    linked &= blk[order][:, None] != blk[order][None, :]
                if probing:
                    linked &= own_of[order][:, None] | own_of[order][None, :]
                linked &= keys[order][:, None] != keys[order][None, :]
                some = np.flatnonzero(linked.any(1))
                if len(some):
                    root = forest(linked)
                    yield pa.RecordBatch.from_arrays([pa.array(names[keys[order][some]], pa.binary()), pa.array(names[keys[order][root[some]]], pa.binary()), pa.array((linked @ copies[order])[some].astype(np.int64))], ["a", "b", "links"])

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.95, tables: int = TABLES, probes: int = PROBES, width: float = WIDTH, seed: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id_col, n_links, component_id, kept), one row per input row.

    Links are pairs found with cosine >= ``least``: components come from pairs that met in a cell, and
    within a component all pairs are compared. Vectors of one direction are one vertex, hashed and compared once however
    many rows have it; they link with each other. Null and zero vectors and
    those with null, NaN or infinite entries link with nothing, nor do vectors of different length.
    Rows that repeat an id are one vector (that which hashes least). Rows without
    an id have a null component and aren't kept. Extra columns are ignored.
    """
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    one = src.where("id is not null").groupBy("id").agg(F.min_by("v", F.xxhash64("v")).alias("v"))
    unit = stash(one.mapInArrow(_united, "id long, key binary, unit binary"))
    classes = stash(unit.groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.any_value("unit").alias("unit")))
    placed = stash(classes.select("key", "unit").mapInArrow(_hashed(tables, probes, width, seed), "key binary, cell long, own boolean"))
    company = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.count_if("own").alias("o")).where("n > 1 and o > 0").select("cell")
    met = placed.join(company, "cell").withColumn("w", F.lit(1))
    in_cells = block_pairs(met, "cell", "key", "w", BLOCK).join(classes, "key").select("cell", "i", "j", "key", "blk", "own", "copies", "unit")
    found = stash(in_cells.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j").mapInArrow(_linked("cell", least, True), "a binary, b binary, links long").select("a", "b").where("a <> b").distinct())
    comp = stash(connected_components(found).select(F.col("id").alias("key"), F.col("component").alias("root")))
    unstash(placed, found)
    members = block_pairs(comp.withColumn("w", F.lit(1)), "root", "key", "w", BLOCK).join(classes, "key").select("root", "i", "j", "key", "blk", "copies", "unit")
    counts = members.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(_linked("root", least, False), "a binary, b binary, links long")
    degree = counts.groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    tied = comp.join(classes.select("key", "least"), "key")
    component = tied.groupBy("root").agg(F.min("least").alias("component"))
    tied = tied.select("key", "root").join(component, "root").join(degree, "key", "left").select("key", "component", "links")
    known = classes.select("key", "least", "copies").join(tied, "key", "left")
    known = stash(known.select("key", "copies", F.coalesce("component", "least").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")))
    judged = join_known(unit.select("id", "key"), known, "key", "copies").select("id", "component", "links")
    out = src.select("id").join(judged, "id", "left")
    at = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), at.alias("component_id"), F.coalesce(at == F.col("id"), F.lit(False)).alias("kept"))
