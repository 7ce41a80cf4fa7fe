"""Byte-pair encoding and decoding of whole texts with a given vocabulary.

Encoder: an Aho-Corasick automaton finds the longest token from each place of a word; tokens
are taken left to right, each only if it is compatible with the token before it, i.e.
if merging the two tokens' symbols by rank gives these two again. A place with no compatible
token is marked dead and the token before it is shortened. What remains is the one
sequence that merging by rank yields, found in time linear in the word.
Decoder: token strings stand in one buffer behind an offset table.

The vocabulary is read on the driver and broadcast (a few MB, fixed); tokenizers are never trained.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain
from math import inf
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeing

#: Words and token pairs that one Python worker keeps.
WORD_CACHE = 500_000
PAIR_CACHE = 1_000_000
#: A word's last symbol stands that far up the code points: it carries the end-of-word suffix.
_LAST = 0x10000
_CONTROLS = re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """One printable character per byte: printable Latin-1 stands for itself, the
    rest follow from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class _Chunks(dict):
    """What ``encode`` gives for a key, computed when it is first asked for."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        # a very long chunk isn't worth its room
        found = self.encode(chunk)
        if len(chunk) <= 64:
            self[chunk] = found
        return found


class Codec:
    """Encodes as the file's own library does without adding special tokens: strings of
    special tokens in a text become their ids; the rest is NFC-normalised, white space and case
    folded, split into words, and every word merged."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model = data["model"]
        self.suffix = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        split = next(p for p in data["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.space = regex.compile(r"\p{White_Space}+")
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.symbol = dict(enumerate(byte_symbols()))
        every = vocab | self.special
        size = max(every.values()) + 1
        blob, ends = bytearray(), np.zeros(size + 1, np.int64)
        named = {i: t for t, i in every.items()}
        for i in range(size):
            blob += named.get(i, "").encode()
            ends[i + 1] = len(blob)
        self.blob, self.offsets = bytes(blob), ends
        self.pieces = [self.blob[ends[i] : ends[i + 1]] for i in range(size)]
        self.digits = [str(i) for i in range(size)]
        self.form = {}
        self.length = [0] * size
        self.shorter = [-1] * size
        for t, i in vocab.items():
            f = t
            if t.endswith(self.suffix) and len(t) > len(self.suffix):
                t = t[: -len(self.suffix)]
                f = t[:-1] + chr(ord(t[-1]) + _LAST)
            self.form[i] = f
            self.length[i] = len(f)
        by_form = {f: i for i, f in self.form.items()}
        self.backwards = ahocorasick.Automaton()
        for f, i in by_form.items():
            self.backwards.add_word(f[::-1], i)
            for n in range(len(f) - 1, 0, -1):
                if (s := by_form.get(f[:n])) is not None:
                    self.shorter[i] = s
                    break
        self.backwards.make_automaton()
        self.rank: dict[tuple[int, int], int] = {}
        self.made_of: dict[int, tuple[int, tuple[int, int]]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            whole = vocab.get(a + b)
            if whole is not None and a in vocab and b in vocab:
                self.rank.setdefault((vocab[a], vocab[b]), r)
                self.made_of.setdefault(whole, (r, (vocab[a], vocab[b])))
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.chunks = _Chunks(self._chunk)

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The pieces that end (side 1) or begin (side 0) ``token`` while it is being merged, smallest
        first, each with the rank of the merge that takes it up."""
        out = [(token, inf)]
        while (made := self.made_of.get(out[-1][0])) is not None:
            rank, parts = made
            out.append((parts[side], rank))
        return out[::-1]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the symbols of both gives just these two tokens; kept in a table.
        Not so if two of the pieces that meet at their border merge before either is taken
        up on its own side."""
        if len(self.pairs) >= PAIR_CACHE:
            self.pairs.clear()
        left, right, i, j = self._spine(a, 1), self._spine(b, 0), 0, 0
        found = None
        while found is None:
            (x, until_x), (y, until_y) = left[i], right[j]
            rank = self.rank.get((x, y), inf)
            if rank < until_x and rank <= until_y and rank < inf:  # of equal ranks the leftmost merges first
                found = False
            elif until_x == until_y == inf:
                found = True
            elif until_x <= until_y:
                i += 1
            else:
                j += 1
        self.pairs[a << 20 | b] = found
        return found

    def encode_word(self, word: str) -> tuple[int, ...]:
        text = word if word.isascii() and word.isprintable() else word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.symbol)
        text = text[:-1] + chr(ord(text[-1]) + _LAST)
        n = len(text)
        # backwards, a match's end is its start; of those at one place the automaton reports the longest first
        longest = dict(list(self.backwards.iter(text[::-1]))[::-1])
        length, shorter, pairs = self.length, self.shorter, self.pairs
        dead, taken, at, token = set(), [], 0, longest[n - 1]
        while at < n:
            if token < 0:
                dead.add(at)
                token = taken.pop()
                at -= length[token]
                token = shorter[token]
                continue
            end = at + length[token]
            if end in dead:
                token = shorter[token]
            elif not taken or (fits := pairs.get(taken[-1] << 20 | token)) or fits is None and self.compatible(taken[-1], token):
                taken.append(token)
                at = end
                token = longest[n - 1 - at] if at < n else 0
            else:
                token = shorter[token]
        return tuple(taken)

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        """Tokens of a stretch of text without white space; no word and no composed character crosses white space."""
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk)
        out: tuple[int, ...] = ()
        # every character is lowered by itself: no final form of sigma
        for w in self.words.findall(chunk.replace("Σ", "σ").lower()):
            found = self.known.get(w)
            if found is None:
                found = self.encode_word(w)
                if len(w) <= 64:
                    if len(self.known) >= WORD_CACHE:
                        self.known.clear()
                    self.known[w] = found
            out += found
        return out

    def _plain(self, text: str) -> Iterator[int]:
        # str.split() also parts at four control characters that are no white space to the vocabulary
        chunks = self.space.split(text) if _CONTROLS.search(text) else text.split()
        return chain.from_iterable(map(self.chunks.__getitem__, chunks))

    def encode(self, text: str | None) -> list[int]:
        if len(self.chunks) > WORD_CACHE:
            self.chunks.clear()
        text = text or ""
        if not self.specials or not self.specials.search(text):
            return list(self._plain(text))
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + list(self._plain(text[at:]))

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of the token strings with one space between: what a vocabulary without a decoder gives."""
        return b" ".join(map(self.pieces.__getitem__, ids))

    def forget(self) -> None:
        """Lets go of the words met; the tables stay."""
        self.known.clear()
        self.chunks.clear()


_LOADED: dict[str, Codec] = {}


def codec(spec: str) -> Codec:
    """One codec per vocabulary and Python process."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Codec(spec)
    return _LOADED[key]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Encodes and decodes every text: (id_col, n_tokens, ids_sha256, decoded_sha256 and, with
    ``with_ids``, ids array<int> and decoded string).

    Null texts are empty: no tokens, the digests of an empty string. Rows keep their number, repeated
    rows and null ids included; other columns are left behind."""
    spec = Path(path or default_vocabulary()).read_text()
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for batch in batches:
            n, a, b, ids, decoded = [], [], [], [], []
            for text in batch.column("_t"):
                got = c.encode(text.as_py())
                back = c.decode(got)
                n.append(len(got))
                a.append(hashlib.sha256(" ".join(map(c.digits.__getitem__, got)).encode()).hexdigest())
                b.append(hashlib.sha256(back).hexdigest())
                if with_ids:
                    ids.append(got)
                    decoded.append(back.decode())
            cols = [batch.column("_i"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = ["_i", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols += [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)
        c.forget()

    src = docs.select(F.col(id_col).alias("_i"), F.col(text_col).cast("string").alias("_t"))
    kind = src.schema["_i"].dataType.simpleString()
    out = src.mapInArrow(freeing(run), f"_i {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else ""))
    return out.withColumnRenamed("_i", id_col)
