"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly.

A word's vector is the mean of the vectors of its hashed character n-grams (and of the whole
word), a passage's the mean of its words', and a two-class softmax over that mean
says how toxic the passage is; embeddings and softmax start from small random numbers and are fitted
together in numpy. A misspelt or inflected word that was never seen still has most of its n-grams.

An average over a whole long text would drown a few words among thousands, so the passages are
windows of WINDOW words that overlap by half (a word said twice in a window counts once there; short
texts are padded with nothing); a text scores as its most toxic window, in training and in use alike.
What that costs against plain averages: a text toxic only as a whole, with no such passage, isn't found.

Fitted on the driver on a bounded sample of the labelled rows (``max_rows``), applied on
the executors with the model in a broadcast of fixed size (2^BITS numbers).
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import freeing, mix64

BITS = 18
DIM = 8
WINDOW = 4
MIN_GRAM, MAX_GRAM = 3, 5
#: n-grams found in fewer training texts keep no vector: they could only be learnt by heart.
MIN_TEXTS = 4
#: Logit of a text without words, and the weight in training of one that is clean.
BIAS, EMPTY = -4.0, 0.5
EPOCHS, RATE = 100, 0.1
#: Longer runs of word characters (unspaced scripts, joined words) are taken in pieces that overlap by MAX_GRAM - 1.
PIECE = 64
#: Words whose n-grams are hashed at a time, so that what the driver holds is bounded by the n-grams kept.
SLICE = 20_000
WORD_CACHE = 1_000_000
#: Labelled rows fitted on at most: all of a small label table, else those least by hash of id.
MAX_ROWS = 5_000
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    """The words of the whole text in order."""
    return [p for w in _WORD.findall((text or "").lower()) for p in ((w,) if len(w) <= PIECE else pieces(w))]


def pieces(run: str) -> list[str]:
    """The whole of a long run as words of at most PIECE characters; every n-gram of it is in one of them."""
    step = PIECE - MAX_GRAM + 1
    return [run[k : k + PIECE] for k in range(0, len(run) - MAX_GRAM + 1, step)]


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word): the hash buckets of every word and of its character n-grams, ends
    marked, all words at once."""
    marked = [f"<{w}>" for w in words]
    length = np.fromiter(map(len, marked), np.int64, len(marked))
    cp = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(marked)), length)
    start = np.cumsum(length) - length
    left = np.repeat(start + length, length) - np.arange(len(cp))
    place = (np.arange(len(cp)) - np.repeat(start, length)).astype(np.uint64)
    whole = np.add.reduceat(mix64(cp + (place << np.uint64(32))), start) if len(marked) else np.empty(0, np.uint64)
    buckets, owners = [mix64(whole)], [np.arange(len(marked))]
    h = np.zeros(len(cp), np.uint64)
    for n in range(1, MAX_GRAM + 1):
        at = np.flatnonzero(left >= n)
        h[at] = h[at] * np.uint64(0x100000001B3) + cp[at + n - 1] + np.uint64(n)
        if n >= MIN_GRAM:
            buckets.append(mix64(h[at]))
            owners.append(word[at])
    bucket = np.concatenate(buckets) >> np.uint64(64 - BITS)
    return bucket.astype(np.int32), np.concatenate(owners).astype(np.int32)


def _in_windows(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per word of a text: does it count in the window that begins with its half, and in the one that ends with it?
    It does unless it was said before in that window."""
    order = np.argsort(ids, kind="stable")
    said = np.full(len(ids), -WINDOW, np.int64)
    same = ids[order][1:] == ids[order][:-1]
    said[order[1:][same]] = order[:-1][same]
    begins = np.arange(len(ids)) // (WINDOW // 2) * (WINDOW // 2)
    return said < begins, said < begins - WINDOW // 2


@dataclass
class Model:
    """weight: what each n-gram bucket's embedding adds to the difference of the
    two logits (the softmax is linear, so embedding times weights is all a score needs)."""

    weight: np.ndarray
    bias: float

    def logit(self, ids: np.ndarray, logits: np.ndarray) -> float:
        """Of the highest window, from the words of a text (equal words: equal ids) and their logits."""
        if not len(ids):
            return self.bias
        here, before = _in_windows(ids)
        half = np.arange(len(ids)) // (WINDOW // 2)
        first, second = np.bincount(half, logits * here), np.bincount(half, logits * before)
        total = first.copy()
        total[:-1] += second[1:]
        return float((total if len(total) == 1 else total[:-1]).max() / WINDOW + self.bias)

    def score(self, ids: np.ndarray, logits: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(ids, logits), -30, 30))))


class _Logits:
    """Id and logit of every word met; those that are new in a text are computed together."""

    def __init__(self, weight: np.ndarray):
        self.weight, self.known, self.logit = weight, {}, np.empty(0)

    def look(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > WORD_CACHE:
            self.known, self.logit = {}, np.empty(0)
        new = list({*words}.difference(self.known))
        if new:
            bucket, owner = subwords(new)
            n = len(self.known)
            self.known.update(zip(new, range(n, n + len(new))))
            if len(self.known) > len(self.logit):
                self.logit = np.concatenate([self.logit, np.empty(max(len(self.known), 4096))])
            self.logit[n : n + len(new)] = np.bincount(owner, self.weight[bucket], len(new)) / np.bincount(owner, minlength=len(new))
        ids = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        return ids, self.logit[ids]


def _kept_grams(vocab: list[str], in_texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, sub, of_word, grams): buckets found in MIN_TEXTS words' texts or more; the place in ``name`` and the word of each
    n-gram kept; and how many n-grams each word has in all. Words are hashed slice by slice."""
    texts, slices = np.zeros(1 << BITS), range(0, len(vocab), SLICE)
    for lo in slices:
        bucket, owner = subwords(vocab[lo : lo + SLICE])
        texts += np.bincount(bucket, in_texts[owner + lo], 1 << BITS)
    name = np.flatnonzero(texts >= MIN_TEXTS)
    place = np.full(1 << BITS, -1, np.int32)
    place[name] = np.arange(len(name))
    sub, of_word, grams = [], [], []
    for lo in slices:
        bucket, owner = subwords(vocab[lo : lo + SLICE])
        at = place[bucket]
        sub.append(at[at >= 0])
        of_word.append((owner[at >= 0] + lo).astype(np.int32))
        grams.append(np.bincount(owner, minlength=min(SLICE, len(vocab) - lo)).astype(np.float32))
    return name, np.concatenate(sub), np.concatenate(of_word), np.concatenate(grams)


def _sums(at: np.ndarray, value: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Sums of value[of] by ``at``, a slice at a time so that no copy is as long as ``of``."""
    out = np.zeros(n)
    for lo in range(0, len(at), 1 << 19):
        out += np.bincount(at[lo : lo + (1 << 19)], value[of[lo : lo + (1 << 19)]], n)
    return out


def fit(rows: Iterable[tuple[str | None, int]], epochs: int = EPOCHS, rate: float = RATE, decay: float = 1e-6, seed: int = 7) -> Model:
    """Joint training by Adam from (text, label), read once. Every window of a clean text is clean, and so is the empty text. A toxic text's
    label is dealt to its windows by a softmax of their logits that grows sharper round by round: to all alike
    at first, to the highest alone at last."""
    vocab: dict[str, int] = {}
    in_texts, word_at, win_at, wins, y = array("i"), array("i"), array("i"), [], []
    for text, label in rows:
        if not (words := words_of(text)):
            continue
        ids = np.fromiter((vocab.setdefault(w, len(vocab)) for w in words), np.int32, len(words))
        in_texts.frombytes(np.unique(ids).tobytes())
        here, before = _in_windows(ids)
        half = (np.arange(len(ids)) // (WINDOW // 2)).astype(np.int32)
        n = max(1, int(half[-1]))  # the last half begins no window of its own, unless it is all there is
        here, before = here & (half < n), before & (half > 0)
        word_at.frombytes(np.concatenate([ids[here], ids[before]]).tobytes())
        base = wins[-1] if wins else 0
        win_at.frombytes((np.concatenate([half[here], half[before] - 1]) + np.int32(base)).tobytes())
        wins.append(base + n)
        y.append(float(label))
    y = np.array(y)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1 << BITS, np.float32), BIAS)
    word_at, win_at = np.frombuffer(word_at, np.int32), np.frombuffer(win_at, np.int32)
    n_win, first = wins[-1], np.array([0, *wins[:-1]])
    win_doc = np.repeat(np.arange(len(y), dtype=np.int32), np.diff([0, *wins]))
    name, sub, of_word, grams = _kept_grams(list(vocab), np.bincount(np.frombuffer(in_texts, np.int32)).astype(np.float32))
    del vocab, in_texts
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.02, (len(name), DIM)).astype(np.float32)
    soft, bias = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (emb, soft, bias)]
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())).astype(np.float32)[win_doc]
    clean = y[win_doc] == 0

    def windows(delta: np.ndarray) -> np.ndarray:
        word = _sums(of_word, emb @ delta, sub, len(grams)) / grams
        return (_sums(win_at, word, word_at, n_win) / WINDOW + bias[1] - bias[0]).astype(np.float32)

    for epoch in range(epochs):
        delta = soft[:, 1] - soft[:, 0]
        z = windows(delta)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        sharp = np.exp(np.minimum((z - np.maximum.reduceat(z, first)[win_doc]) * np.float32(8.0 * epoch / epochs), 0))
        dealt = sharp / np.add.reduceat(sharp, first)[win_doc]
        g = np.where(clean, p, p - 1) * share * dealt
        g_word = _sums(word_at, g, win_at, len(grams)) / WINDOW
        g_gram = _sums(sub, g_word / grams, of_word, len(name)).astype(np.float32)
        g_soft = emb.T @ g_gram
        g_bias = np.float32(g.sum() + EMPTY / (1 + np.exp(bias[0] - bias[1])))
        grads = [g_gram[:, None] * delta[None, :] + decay * emb, np.stack([-g_soft, g_soft], 1) + decay * soft, np.array([-g_bias, g_bias])]
        for p_, gr, m in zip((emb, soft, bias), grads, moments):
            m[0] += 0.1 * (gr - m[0])
            m[1] += 0.001 * (gr * gr - m[1])
            step = rate * np.sqrt(1 - 0.999 ** (epoch + 1)) / (1 - 0.9 ** (epoch + 1))
            p_ -= step * m[0] / (np.sqrt(m[1]) + 1e-7)
    delta = soft[:, 1] - soft[:, 0]
    weight = np.zeros(1 << BITS, np.float32)
    weight[name] = emb @ delta
    model = Model(weight, float(bias[1] - bias[0]))
    # the softmax was fitted to balanced classes; its zero moves to where the fewest texts are wrong. The
    # words' weights move with it, so that a text that tells nothing stays clean
    z = np.maximum.reduceat(windows(delta), first).astype(np.float64)
    order = np.argsort(z)
    wrong = np.concatenate(([0], np.cumsum(np.where(y[order] == 1, 1, -1)))) + (y == 0).sum()
    best = np.flatnonzero(wrong == wrong.min())
    cut = float(np.median([(z[order[max(0, k - 1)]] + z[order[min(len(z) - 1, k)]]) / 2 for k in best])) - model.bias
    if cut <= 0:
        return model
    return Model((weight * (-BIAS / cut)).astype(np.float32), BIAS)


def held_out(id_col: str | Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS) -> Model:
    """Fits on labelled documents that aren't held out: at most ``max_rows`` of them, half of
    these at most by hash of id from each class, so the driver holds a bounded sample.
    Null labels, ids and texts don't count. Without labels of both classes
    the model knows no toxic word and every text is clean."""
    mine = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    mine = mine.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    by_hash = F.xxhash64("id", F.lit(5))
    chosen = mine.where("y = 1").orderBy(by_hash, "id").limit(max_rows // 2).union(mine.where("y = 0").orderBy(by_hash, "id").limit(max_rows // 2))
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).where("t is not null")
    rows = text.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("t").alias("t"), F.first("y").alias("y")).orderBy("id")
    return fit((r["t"], r["y"]) for r in rows.toLocalIterator())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` columns ``keep`` and id, with score (0..1) and predicted (score >= 0.5); columns kept under these two names are replaced.

    Null and empty texts score as clean; rows keep their number and
    repeated rows score alike."""
    cols = list(dict.fromkeys([id_col, *(c for c in keep if c not in ("score", "predicted"))]))
    shared = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias))
    src = docs.select(*cols, F.col(text_col).alias("_scored"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        table = _Logits(m.weight)
        for batch in batches:
            s = [m.score(*table.look(words_of(t.as_py()))) for t in batch.column("_scored")]
            names = [f for f in batch.schema.names if f != "_scored"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(s, pa.float64())], [*names, "score"])

    schema = src.drop("_scored").schema.add("score", "double")
    out = src.mapInArrow(freeing(run), schema)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that score as toxic, columns as they were. Documents
    without a text stay."""
    cols = docs.columns
    plain = docs.toDF(*[f"_c{i}" for i in range(len(cols))])
    own = dict(zip(cols, plain.columns))
    out = score(plain, train(docs, labels), own["doc_id"], own["text"], keep=tuple(plain.columns))
    return out.where("predicted = 0").select(*[F.col(own[c]).alias(c) for c in cols])
