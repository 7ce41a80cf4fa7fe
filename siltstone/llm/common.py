"""What several corpus operators share: tables in the shared folder, connected
components, and the splitting of large groups into pairs of bounded blocks.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is hinted for broadcast only after a count shows at most so many rows and bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``. Only in a local session
    that has none, where all is one machine, a temporary folder is made and set; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="siltstone-")
        spark.sparkContext.setCheckpointDir(found)
    return found


_SCOPES: list[list[DataFrame]] = []


def stash(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends there,
    and losing an executor costs nothing that was stashed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    for scope in _SCOPES[-1:]:
        scope.append(out)
    return out


@contextmanager
def scratch() -> Iterator[None]:
    """What is stashed within is deleted when it ends: for callers who have written or collected an operator's result by then."""
    made: list[DataFrame] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.remove(made)
        unstash(*made)


def unstash(*frames: DataFrame) -> None:
    """Deletes stashed tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_stash_path", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def sized(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most so many rows and bytes (texts are measured, other values taken as 16 bytes each); else as it is,
    and the join that reads it shuffles. Give it stashed tables: it counts them."""
    texts = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("string", "binary")]
    found = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.octet_length(F.col(f"`{c}`"))).alias(f"t{k}") for k, c in enumerate(texts)]).first()
    held = 16 * len(df.columns) * found["n"] + sum(found[f"t{k}"] or 0 for k in range(len(texts)))
    return F.broadcast(df) if found["n"] <= rows and held <= size else df


#: A key with more than one in so many rows is joined by broadcast; there can't be more of these.
HOT = 10_000


def join_known(rows: DataFrame, known: DataFrame, key: str | list[str], copies: str) -> DataFrame:
    """Left join of ``rows`` with ``known`` (one row per key, ``copies`` saying how many rows have it). Keys that many rows share, at most
    HOT of them, come to the rows by broadcast, so that no task gets all rows of one."""
    total = known.agg(F.sum(copies)).first()[0] or 0
    often = F.broadcast(known.where((F.col(copies) * HOT > total) & (F.col(copies) > 1000)))
    hot = rows.join(often, key)
    rest = rows.join(often.select(key), key, "left_anti").join(known, key, "left")
    return hot.unionByName(rest.select(*hot.columns))


def pieces_of(counts: DataFrame, key: list[str], pieces: int = 200) -> DataFrame:
    """(key, _n): into how many parts the rows of a key are dealt, for keys that more than one in ``pieces`` rows has as ``counts`` (key, copies)
    tells. There are at most ``pieces`` of them, and as many parts more than keys."""
    total = counts.agg(F.sum("copies")).first()[0] or 1
    return counts.select(*key, (F.floor(F.col("copies") * pieces / total) + 1).cast("int").alias("_n")).where("_n > 1")


def dealt(rows: DataFrame, often: DataFrame, key: list[str], deal: Column) -> DataFrame:
    """``rows`` with the part of their key (``_part``) that the number ``deal`` puts them in."""
    return rows.join(F.broadcast(often), key, "left").withColumn("_part", F.pmod(deal, F.coalesce("_n", F.lit(1))).cast("int")).drop("_n")


def repeated(store: DataFrame, often: DataFrame, key: list[str]) -> DataFrame:
    """``store`` (one row per key) with its row for every part (``_part``) of the key."""
    return store.join(F.broadcast(often), key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1))).drop("_n")


def join_split(rows: DataFrame, store: DataFrame, key: str | list[str], counts: DataFrame, deal: Column, pieces: int = 200) -> DataFrame:
    """Inner join of ``rows`` with ``store`` (one row per key). A key that more than one in ``pieces`` rows has, as ``counts`` (key, copies) tells, is dealt to
    several tasks by the number ``deal``, and its row of ``store`` repeated for them: ``pieces`` more rows at most, for all keys together."""
    keys = [key] if isinstance(key, str) else key
    often = pieces_of(counts, keys, pieces)
    return dealt(rows, often, keys, deal).join(repeated(store, often, keys), [*keys, "_part"]).drop("_part")


def connected_components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """``edges`` (a, b of one type that has an order) -> (id, component): the smallest id reachable,
    for every id with an edge. Null ends and loops are left out.

    First, twice: of a vertex's smaller neighbours only the least stays its own, the others are
    tied to that one, and what many vertices say of the same few hubs becomes one edge. Then
    each round takes the least label among the neighbours and that label's own label, so
    paths shorten by more than half. Every round is stashed."""
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    for _ in range(2):
        tied = stash(e.withColumn("m", F.expr("min(b) over (partition by a)")))
        e = stash(tied.select("a", F.col("m").alias("b")).union(tied.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct())
        unstash(tied)
    e = stash(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    lab = stash(e.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component"), F.lit(True).alias("moved")))
    for _ in range(most_rounds):
        near = e.join(lab.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        best = lab.select("id", F.col("component").alias("old")).join(near, "id").select("id", "old", F.least("old", "m").alias("at"))
        new = stash(best.join(lab.select(F.col("id").alias("at"), "component"), "at").select("id", "component", (F.col("component") < F.col("old")).alias("moved")))
        unstash(lab)
        lab = new
        if not lab.where("moved").take(1):
            unstash(e)
            return lab.select("id", "component")
    raise RuntimeError(f"components did not settle within {most_rounds} rounds")


def block_pairs(members: DataFrame, key: str, member: str, weight: str, budget: int) -> DataFrame:
    """Splits every group into blocks of about ``budget`` summed ``weight`` and
    repeats each member for every pair (i <= j) of blocks that holds its own block
    ``blk``: together the pairs of blocks see every pair of members, none sees more
    than two blocks, and a group of any size spreads over many tasks."""
    # only groups that are split need their total, and there are at most weight / budget of them: no group is gathered to be told its size
    total = stash(members.groupBy(key).agg(F.sum(weight).alias("_total")).where(F.col("_total") > budget))
    n = F.ceil(F.col("_total") / F.lit(budget)).cast("int")
    split = members.join(sized(total), key, "left").withColumn("_n", F.coalesce(n, F.lit(1))).withColumn("blk", F.pmod(F.xxhash64(member, F.lit(17)), F.col("_n")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    return split.withColumn("_o", other).withColumn("i", F.least("blk", "_o").cast("int")).withColumn("j", F.greatest("blk", "_o").cast("int")).drop("_total", "_n", "_o")


def freeing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int = 1000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow in little memory: batches come in slices of ``rows``, and what was held is given back when a task ends, since Python
    workers stay on for other tasks and would keep it."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(b.slice(lo, rows) for b in batches for lo in range(0, b.num_rows, rows))
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not glibc
            pass

    return wrapped


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of equal ``keys`` from batches that come sorted by them. Holds one
    group (and one batch) at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1 if batch.num_rows > 1 else np.array([], int)
        edges = [0, *change.tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            at = tuple(c[lo] for c in cols)
            if held and at != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = at
    if held:
        yield pa.Table.from_batches(held)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply), element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def forest(linked: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix, the smallest index that each row reaches."""
    label = np.arange(len(linked))
    while True:
        near = np.where(linked, label[None, :], len(linked)).min(axis=1, initial=len(linked))
        new = np.minimum(label, near)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new
