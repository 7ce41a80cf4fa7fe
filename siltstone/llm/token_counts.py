"""Token counts of whole texts for a piece vocabulary, by merging a heap of adjacent pairs over a linked list of symbols.

A stretch of text starts as its characters. The heap holds the neighbours that together are a piece; the pair of the lowest rank, the
leftmost of equals, is merged again and again, and its two new neighbours come in. Every merge makes one symbol of two, so the count is the number of
initial symbols less the number of merges: no token is looked up or emitted. A character that is no piece counts as its UTF-8 bytes.

No merge crosses a place between two characters that no piece holds side by side, so texts are cut there, and a worker keeps the counts of
the stretches it met.
"""

from __future__ import annotations

import hashlib
import re
import tempfile
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeing

#: Stretches whose count a Python worker keeps, and how long they may be.
KEPT, SHORT = 500_000, 48
#: Longer texts are cut as they are read, not at once.
LONG = 1_000_000
#: What the vocabulary writes for a space, and puts before every text that isn't empty.
SPACE = "▁"


class Counter(dict):
    """Stretches and their counts; a stretch is counted when it is first asked for. Made from a serialised ``.model`` of the byte-pair kind that
    leaves texts as they are, but for spaces."""

    def __init__(self, model: bytes):
        import sentencepiece

        with tempfile.NamedTemporaryFile() as file:  # read again below, in this process only
            file.write(model)
            file.flush()
            read = sentencepiece.SentencePieceProcessor(model_file=file.name)
        probe = " Aééﬁ\t  　Ａ \n"
        if read.normalize(probe) != (SPACE + probe).replace(" ", SPACE):
            raise ValueError("this vocabulary normalises texts, which isn't supported")
        pieces = {}
        for i in range(read.get_piece_size()):
            if not (read.is_control(i) or read.is_unknown(i) or read.is_byte(i)):
                pieces[read.id_to_piece(i)] = -read.get_score(i)
        self.rank = pieces
        held = {c for p in pieces for c in p}
        inner = "".join(map(re.escape, sorted(held - {SPACE})))
        self.side_by_side = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        # a piece has its spaces in front, or else texts are only cut at characters of no piece
        front = all(SPACE not in p.lstrip(SPACE) for p in pieces)
        self.stretch = re.compile(f"{SPACE}*[{inner}]+|{SPACE}+|[^{inner}{SPACE}]" if front else f"[{inner}{SPACE}]+|[^{inner}{SPACE}]")

    def __missing__(self, stretch: str) -> int:
        held, start, found = self.side_by_side, 0, 0
        for i in range(1, len(stretch)):
            if stretch[i - 1 : i + 1] not in held:
                found += self[stretch[start:i]]
                start = i
        found += self[stretch[start:]] if start else self.merged(stretch)
        if len(stretch) <= SHORT:
            if len(self) >= KEPT:
                self.clear()
            self[stretch] = found
        return found

    def merged(self, text: str) -> int:
        """The number of symbols of ``text`` that remain when no two neighbours are a piece."""
        rank = self.rank
        n = len(text)
        size = [1] * n  # of the symbol that begins here; 0 where one was merged away
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank.get(text[i : i + 2])) is not None]
        heapify(heap)
        merges = 0
        while heap:
            _, i, both = heappop(heap)
            j = right[i]
            if not size[i] or j == n or size[i] + size[j] != both:  # a part has merged otherwise meanwhile
                continue
            size[i], size[j] = both, 0
            merges += 1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (r := rank.get(text[i : k + size[k]])) is not None:
                    heappush(heap, (r, i, both + size[k]))
            if (h := left[i]) >= 0 and (r := rank.get(text[h : i + both])) is not None:
                heappush(heap, (r, h, size[h] + both))
        # a character of no piece that nothing took up counts as its bytes
        more = sum(len(text[i].encode()) - 1 for i in range(n) if size[i] == 1 and text[i] not in rank)
        return n - merges + more

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)
        if len(text) > LONG:
            return sum(self[m[0]] for m in self.stretch.finditer(text))
        return sum(map(self.__getitem__, self.stretch.findall(text)))


_LOADED: dict[str, Counter] = {}


def counter(model: bytes) -> Counter:
    """One per vocabulary and Python process."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Counter(model)
    return _LOADED[key]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def count(docs: DataFrame, path: str | None = None, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit), one row per input row: the UTF-8 bytes of the whole text, its tokens without any added at
    the ends, and whether there are more than ``limit``.

    Null texts are empty: no bytes, no tokens. Strings of control pieces inside a text are ordinary text. Rows keep their number, repeated
    rows and null ids included; other columns are left behind. The vocabulary (some 500 kB, fixed) is read on the driver and broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(Path(path or default_vocabulary()).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(shared.value)
        for batch in batches:
            n = [c.count(text.as_py()) for text in batch.column("_t")]
            yield pa.RecordBatch.from_arrays([batch.column("_i"), batch.column("_n"), pa.array(n, pa.int64())], ["_i", "_n", "_tokens"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(F.col(id_col).alias("_i"), F.octet_length(text).cast("long").alias("_n"), text.alias("_t"))
    kind = src.schema["_i"].dataType.simpleString()
    out = src.mapInArrow(freeing(run), f"_i {kind}, _n long, _tokens long")
    return out.select(F.col("_i").alias(id_col), F.col("_n").alias("n_bytes"), F.col("_tokens").alias("n_tokens"), (F.col("_tokens") > limit).alias("over_limit"))
