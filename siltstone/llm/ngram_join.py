"""N-gram Jaccard self-join by PartEnum signatures.

A document is its set of distinct word n-grams. Two sets within one size band
and with Jaccard >= t differ in at most k elements; the hashed feature domain is cut
into parts of a few cells each, and a signature is the content of a part without one cell. There are more parts
than k differences can spoil, so similar sets share not just one signature but at least a known number of them. Sets near a
band's upper edge are signed for the next band too. A set that shares fewer signatures with others than
any partner would guarantee has no partner and goes; what is left are candidates, verified by exact
intersection counts.

Scale: texts are read for keys, for signatures, and once more for candidates only; no
signature is stored. Equal sets are one vertex. Signatures are combined in each task before they are shuffled once, so that what many
sets of a task share is shuffled as one row; every
bucket yields a star of edges to its smallest member, never its pairs. The stars' components
are compared exhaustively in pairs of bounded blocks, so a group may be of any size,
and only degrees and spanning edges leave a block.

Sets are told apart by 64-bit hashes, as n-grams are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import block_pairs, connected_components, forest, freeing, grouped, join_known, mix64, sized, stash, unstash

#: Distinct words whose hashes one Python worker keeps.
WORD_CACHE = 1_000_000
#: n-grams (and 800 more a document) that a block of a group holds.
BLOCK = 400_000
#: Largest k for which every two of k + 2 cells are a signature.
FEW = 6
#: Parts beyond those that k differences can spoil, as a share of these: more make a partner guarantee more shared signatures.
SPARE = 0.4
#: Signatures that are combined in a task before they are shuffled.
CHUNK = 250_000
#: Sets remembered by a task, so that copies are signed once.
SEEN = 500_000


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def ngram_set(text: str | None, n: int, words: _Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of the words between ASCII
    white space, A-Z lower-cased. Fewer than n words: the sequence is one n-gram."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    width = min(n, len(w))
    acc = np.full(len(w) - width + 1, width, np.uint64)
    for i in range(width):
        acc = mix64(acc + w[i : len(w) - width + 1 + i])
    return np.unique(acc)


@cache
def _bands(percent: int) -> tuple[list[int], list[int]]:
    """Lower edges of the size bands, whose upper edge is about 1.5 times the lower, and the
    largest symmetric difference k of two sets of a band, up to 2^40 elements."""
    wide = max(1.5, 100 / percent)
    low, k = [1], []
    while low[-1] < 1 << 40:
        low.append(max(low[-1] + 1, int(low[-1] * wide)))
        k.append(2 * (low[-1] - 1) * (100 - percent) // (100 + percent))
    return low, k


def _wrapped_sums(at: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Sums modulo 2^64 by index. In two halves, as bincount adds in doubles: exact up to 2^21 values an index."""
    lo = np.bincount(at, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n).astype(np.uint64)
    hi = np.bincount(at, (value >> np.uint64(32)).astype(np.float64), n).astype(np.uint64)
    return lo + (hi << np.uint64(32))


def _sealed(content: np.ndarray, part: np.ndarray, tag: int, code: int) -> np.ndarray:
    return mix64(mix64(content) + mix64((part.astype(np.uint64) << np.uint64(8)) + np.uint64((tag << 44) + code)))


def _few(value: np.ndarray, spread: np.ndarray, k: int, tag: int) -> tuple[int, np.ndarray]:
    """For small k: k + 3 cells, every two of them a signature; k differences leave three pairs of cells untouched."""
    m = k + 3
    where = (spread % np.uint64(m)).astype(np.int64)
    cells, held = _wrapped_sums(where, value, m), np.bincount(where, minlength=m) > 0
    a, b = np.triu_indices(m, 1)
    told = held[a] | held[b]
    need = 3 - int(np.count_nonzero(~told))
    sigs = _sealed(cells[a] + mix64(cells[b]), a * 256 + b, tag, 255)
    return (need, sigs[told]) if need > 0 else (1, sigs)


def _parts(value: np.ndarray, spread: np.ndarray, k: int, tag: int) -> tuple[int, np.ndarray]:
    """n1 = k // 2 + 1 + s parts of two cells; a signature is a part without one of its cells. With d parts that hold one difference and z that
    hold none, d + 2 (n1 - d - z) <= k, so d + 2 z >= 2 s + 1 signatures are shared. Those without any content
    would tie unrelated sets: they are left out, and a set needs as many fewer as it has of these; should it have
    so many that none need be left, it keeps them."""
    n1 = k // 2 + 1
    s = max(2, round(SPARE * n1))
    n1 += s
    at = (((spread >> np.uint64(16)) % np.uint64(n1)) * np.uint64(2) + (spread & np.uint64(1))).astype(np.int64)
    cells, told = _wrapped_sums(at, value, 2 * n1), np.bincount(at, minlength=2 * n1) > 0
    sigs = mix64(mix64(cells) + mix64(np.arange(2 * n1, dtype=np.uint64) + np.uint64(tag << 44)))
    need = 2 * s + 1 - int(np.count_nonzero(~told))
    return (need, sigs[told]) if need > 0 else (1, sigs)


def signatures(features: np.ndarray, percent: int) -> list[tuple[int, int, np.ndarray]]:
    """(band, need, signatures) of a set of 64-bit features, for one or two bands. Any two sets that are similar
    enough have a band in common in which they share at least ``need`` of either's signatures."""
    low, ks = _bands(percent)
    size = len(features)
    if not size:
        return []
    band = int(np.searchsorted(low, size, side="right")) - 1
    tags = [band] + [band + 1] * (100 * size >= percent * low[band + 1])
    spread, value = mix64(features ^ np.uint64(0xA5A5A5A55A5A5A5A)), mix64(features + np.uint64(0x51ED270B))
    out = []
    for tag in tags:
        k = ks[tag]
        if k == 0:
            out.append((tag, 1, _sealed(value.sum(dtype=np.uint64, keepdims=True), np.zeros(1, np.int64), tag, 254)))
        elif k <= FEW:
            out.append((tag, *_few(value, spread, k, tag)))
        else:
            out.append((tag, *_parts(value, spread, k, tag)))
    return out


def _set_key(f: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return xxhash.xxh3_128(f.tobytes()).digest()


def _half(key: bytes) -> int:
    """Half of them, where sets only become candidates: those that share it by chance are compared like any others."""
    return int.from_bytes(key[:8], "big", signed=True)


def _sets_of(batch: pa.RecordBatch, n: int, words: _Words) -> list[np.ndarray]:
    if len(words) > WORD_CACHE:
        words.clear()
    return [ngram_set(t.as_py(), n, words) for t in batch.column("text")]


def _keyed(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            sets = _sets_of(batch, n, words)
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(map(len, sets), pa.int64()), pa.array(map(_set_key, sets), pa.binary())], [*rest, "n", "key"])

    return run


def _combined(keys: list[int], metas: list[int], sigs: list[np.ndarray]) -> pa.RecordBatch:
    """Signature rows of a task's chunk. Of several sets with one signature the first stands for all (``many`` of them) where
    signatures meet; the others already know that they aren't alone, and are spread."""
    size = [len(x) for x in sigs]
    at, sig = np.repeat(np.arange(len(keys)), size), np.concatenate(sigs)
    order = np.argsort(sig, kind="stable")
    new = np.concatenate(([True], sig[order][1:] != sig[order][:-1]))
    run = np.cumsum(new) - 1
    many, first = np.empty(len(sig), np.int64), np.empty(len(sig), bool)
    many[order], first[order] = np.bincount(run)[run], new
    key, meta = np.array(keys, np.int64)[at], np.array(metas, np.int64)[at]
    # in the order of the sets, whose equal keys compress well
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(meta), pa.array(sig.view(np.int64)), pa.array(key, mask=first), pa.array(many)], ["key", "meta", "sig", "spread", "many"])


def _sliced(batch: pa.RecordBatch, rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)


def _signed(n: int, percent: int):
    """(key, meta, sig, spread, many): every set once a task, with each of its signatures; meta holds its band and how
    many shared ones it needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = _Words(), set()
        keys, metas, sigs, held = [], [], [], 0
        for batch in batches:
            for f in _sets_of(batch, n, words):
                key = _set_key(f)
                if key in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                for band, need, sig in signatures(f, percent):
                    keys.append(_half(key))
                    metas.append((band << 40) + need)
                    sigs.append(sig)
                    held += len(sig)
                if held > CHUNK:
                    yield from _sliced(_combined(keys, metas, sigs))
                    keys, metas, sigs, held = [], [], [], 0
        if held:
            yield from _sliced(_combined(keys, metas, sigs))

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = _Words(), set()
        for batch in batches:
            sets = _sets_of(batch, n, words)
            keys = [_set_key(f) for f in sets]
            new = [k for k, key in enumerate(keys) if key not in seen and not seen.add(key)]
            if len(seen) > SEEN:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array([keys[k] for k in new], pa.binary()), pa.array([sets[k].tobytes() for k in new], pa.binary())], ["key", "features"])

    return run


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """How many features each two of the sets share."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    start = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    df = np.diff(np.append(start, len(flat)))
    each = np.repeat(df, df)
    counts = np.zeros(m * m)
    rare = each <= 16
    f, o = flat[rare], owner[rare]
    for step in range(1, min(16, m)):
        same = f[step:] == f[:-step]
        if not same.any():
            break
        counts += np.bincount(o[:-step][same] * m + o[step:][same], minlength=m * m)
    counts = counts.reshape(m, m)
    counts = counts + counts.T
    common = np.flatnonzero(df > 16)
    for lo in range(0, len(common), 2048):
        some = common[lo : lo + 2048]
        grid = np.zeros((m, len(some)), np.float32)
        for c, k in enumerate(some):
            grid[owner[start[k] : start[k] + df[k]], c] = 1
        counts += grid @ grid.T
    return counts


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in grouped(batches, ["cluster", "i", "j"]):
            blk, copies = (g.column(c).to_numpy() for c in ("blk", "copies"))
            ids, raw = np.array(g.column("key").to_pylist(), object), g.column("features").to_pylist()
            once = {i: k for k, i in enumerate(ids)}
            if len(once) < 2:
                continue
            order = np.array([once[k] for k in sorted(once)])
            sets = [np.frombuffer(raw[k], np.uint64) for k in order]
            ids, blk, copies = ids[order], blk[order], copies[order]
            inter = intersections(sets)
            size = np.array([len(s) for s in sets], np.float64)
            linked = 100 * inter >= percent * (size[:, None] + size[None, :] - inter)
            np.fill_diagonal(linked, False)
            if g.column("i")[0].as_py() != g.column("j")[0].as_py():
                linked &= blk[:, None] != blk[None, :]
            some = np.flatnonzero(linked.any(axis=1))
            if not len(some):
                continue
            root = forest(linked)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some], pa.binary()), pa.array(ids[root[some]], pa.binary()), pa.array((linked @ copies)[some].astype(np.int64))], ["a", "b", "links"])

    return run


def _candidates(src: DataFrame, n: int, percent: int) -> DataFrame:
    """(half, cluster): halves of the keys of sets that may have partners, and the component of shared signatures that holds them.

    Partners share as many signatures as either needs; a set with fewer that anyone shares is out. Of need shared ones each
    partner can do without half: so every set leaves out those (need - 1) // 2 of its own that are shared most, licence lines and the like, and
    still one is left to both."""
    signed = src.select("text").mapInArrow(freeing(_signed(n, percent)), "key long, meta long, sig long, spread long, many long")
    over = "over (partition by sig, spread)"
    met = signed.selectExpr("key", "meta", "sig", f"sum(many) {over} as n", f"many > 1 or min(key) {over} <> max(key) {over} as shared").where("shared").select("key", "meta", "sig", "n")
    met = met.groupBy("key", "meta", "sig").agg(F.max("n").alias("n"))
    need = F.col("meta").bitwiseAND((1 << 40) - 1)
    own = Window.partitionBy("key", "meta")
    ranked = met.withColumn("all", F.count(F.lit(1)).over(own)).where(F.col("all") >= need).withColumn("rank", F.row_number().over(own.orderBy(F.desc("n"), "sig")))
    rows = stash(ranked.where(F.col("rank") > F.floor((need - 1) / 2)).select("key", "sig").distinct())
    hubs = stash(rows.groupBy("sig").agg(F.min("key").alias("hub"), F.max("key").alias("top"), F.count(F.lit(1)).alias("copies")).where("hub <> top").drop("top"))
    # a signature that very many sets share is tied to its hub where its rows are
    edges = join_known(rows, hubs, "sig", "copies").where("key <> hub").select(F.col("key").alias("a"), F.col("hub").alias("b"))
    near = stash(connected_components(edges).select(F.col("id").alias("half"), F.col("component").alias("cluster")))
    unstash(rows, hubs)
    return near


def _linked(src: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """``src`` (id, text, ...) -> its rows with n and key instead of text; and (key, n, copies, root, component, links), one row per
    set of rows with an id: root names the component, component is its smallest id."""
    keyed = stash(src.mapInArrow(freeing(_keyed(n)), src.drop("text").schema.add("n", "long").add("key", "binary")))
    near = _candidates(src.where("id is not null"), n, percent)
    classes = stash(keyed.where("n > 0 and id is not null").groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.min("n").alias("n")))
    half = F.conv(F.hex(F.substring("key", 1, 8)), 16, -10).cast("long")
    members = stash(near.join(classes.withColumn("half", half), "half").select("key", "cluster", "copies", "least", (F.col("n") + 800).alias("weight")))
    texts = src.join(sized(members.select(F.col("least").alias("id")).distinct()), "id", "left_semi")
    blocks = block_pairs(members, "cluster", "key", "weight", BLOCK).select("key", "cluster", "copies", "blk", "i", "j")
    sets = texts.select("text").mapInArrow(freeing(_sets(n)), "key binary, features binary")
    pairs = blocks.join(sets, "key").repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    found = stash(pairs.mapInArrow(freeing(_verified(percent)), "a binary, b binary, links long"))
    comp = connected_components(found.select("a", "b")).select(F.col("id").alias("key"), F.col("component").alias("root"))
    degree = found.groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    tied = stash(comp.join(degree, "key", "left").join(classes.select("key", "least"), "key"))
    least = tied.groupBy("root").agg(F.min("least").alias("component"))
    known = classes.join(tied.drop("least").join(least, "root"), "key", "left")
    known = stash(known.select("key", "n", "copies", F.coalesce("root", "key").alias("root"), F.coalesce("component", "least").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")))
    unstash(near, members, found, tied, classes)
    return keyed, known


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """Links documents whose n-gram sets have 100 * |A & B| >= percent * |A | B|.

    Returns (id_col, n_shingles, n_links, component_id), one row per input row:
    n_links counts the other documents linked directly, component_id is the
    smallest id reachable.

    Null, empty and white-space texts have no n-grams and link with nothing. Rows with a
    null id get a null component and link with nothing. Rows that repeat an id are documents of their own,
    each linked as its own text is; equal texts link,
    and every row counts as a link. Extra columns are ignored.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be within 50..100")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    keyed, known = _linked(src, n, percent)
    out = join_known(keyed, known.select("key", "component", "links", "copies"), "key", "copies")
    alone = (F.col("n") == 0) | F.col("id").isNull()
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(alone, F.lit(0)).otherwise(F.col("links")).cast("long").alias("n_links"),
        F.when(alone, F.col("id")).otherwise(F.col("component")).alias("component_id"),
    )


def keep_representatives(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near copies: that of the smallest
    doc_id. Documents without words and rows without an id are no copies and stay. Of rows that repeat an id, those
    of one group stay once (the least by its columns in their order), those of different groups all stay."""
    cols = docs.columns
    plain = docs.toDF(*[f"_c{i}" for i in range(len(cols))])
    own = dict(zip(cols, plain.columns))
    src = plain.select(F.col(own["doc_id"]).cast("long").alias("id"), F.col(own["text"]).cast("string").alias("text"))
    keyed, known = _linked(src, n, percent)
    gone = join_known(keyed.where("n > 0 and id is not null"), known.select("key", "root", "component", "copies"), "key", "copies").select("id", "root", (F.col("id") == F.col("component")).alias("stays"))
    by_id = stash(gone.groupBy("id").agg(F.count(F.lit(1)).alias("rows"), F.max("stays").alias("stays"), F.count_if("stays").alias("kept")).where("not stays or rows > 1"))
    row_id = F.col(own["doc_id"]).cast("long")
    once = plain.join(by_id.select(F.col("id").alias("_drop")), row_id == F.col("_drop"), "left_anti")
    more = stash(plain.join(sized(by_id.where("rows > 1").select(F.col("id").alias("_id"))), row_id == F.col("_id")).withColumn("_row", F.monotonically_increasing_id()))
    # only a row's number goes through Python, whatever other columns there are
    told = more.select("_id", "_row", F.col(own["text"]).cast("string").alias("text")).mapInArrow(freeing(_keyed(n)), more.select("_id", "_row").schema.add("n", "long").add("key", "binary"))
    told = told.join(known.select("key", "root", "component"), "key", "left")
    told = told.where("n = 0 or component = _id").select("_row", "n", "root").join(more, "_row")
    blank = told.where("n = 0").select(*plain.columns)
    least = F.struct(*[ordered(plain, c) for c in plain.columns])
    one = told.where("n > 0").groupBy("_id", "root").agg(F.min_by(F.struct(*plain.columns), least).alias("_kept")).select("_kept.*")
    return once.unionByName(blank).unionByName(one).toDF(*cols)


def ordered(df: DataFrame, column: str) -> Column:
    """The column, or its JSON where its type has no order (maps, variants and what holds them)."""
    kind = df.schema[column].dataType.simpleString()
    return F.to_json(F.struct(column)) if "map<" in kind or "variant" in kind else F.col(column)
