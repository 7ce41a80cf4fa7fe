"""Secret scans: wide candidate patterns, and a random forest that removes false positives.

Candidates are all runs of token characters of at least MIN_LENGTH, with or without digits,
and whatever is assigned to a word like ``password`` or ``token``. The forest judges each by
its length, character transitions, dictionary coverage, vowels, known prefixes, path-like parts and the neighbouring
words. It is trained in numpy, on labelled findings: a list of (text, start, end, label) given by the
caller, or the bounded set that ``labelled_findings`` makes from formats of keys and of look-alikes.
"""

from __future__ import annotations

import base64
import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeing

MIN_LENGTH = 16
REDACTED = "[SECRET]"
KEYWORDS = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "auth", "credential", "private_key", "bearer", "client_secret")
#: Common words of prose, code and paths: what secrets rarely hold.
DICTIONARY = tuple("the and for with from that this have your user name file path data image test value index page home http https www com org net html json node main master branch commit version release build docs example sample change placeholder insert here none null true false default config local public class function import return module package object array string number order invoice item product customer account session request response server client cache table column field record window button header footer content title section style script event update create delete insert select where group".split())
#: What keys of known issuers begin with.
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "sk_live_", "sk_test_", "rk_live_", "xoxb-", "xoxp-", "AIza", "npm_", "hf_", "ey")
_BARE = re.compile(rf"[A-Za-z0-9+/=_.:@-]{{{MIN_LENGTH},}}")
_PATTERN = re.compile(rf"(?P<key>(?i:{'|'.join(map(re.escape, KEYWORDS))}))[\"']?[ \t]{{0,3}}(?P<sign>:=|=>|=|:)[ \t]{{0,3}}[\"']?(?P<value>[^\s\"'<>]{{6,}})|(?P<pem>-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----)")
_NEAR = re.compile(r"[A-Za-z_-]+")
FEATURES = ("length", "transitions", "digit_share", "upper_share", "lower_share", "symbol_share", "hex", "entropy", "dictionary", "path_parts", "dots", "colons_dashes", "assigned", "keyword_near", "harmless_near", "all_digits", "at_sign", "pem", "one_case", "longest_word", "known_prefix", "vowel_share", "longest_consonants", "inner_capitals")
_HARMLESS = frozenset("commit sha sha1 sha256 md5 checksum digest revision rev uuid guid etag hash integrity isbn doi invoice order phone card tel fax version build id".split())


def candidates(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, assigned) of every candidate, left to right."""
    at = 0
    for m in _PATTERN.finditer(text):
        yield from _bare(text, at, m.start())
        at = m.end()
        if m["value"]:
            yield m.start("value"), m.end("value") - (len(m["value"]) - len(m["value"].rstrip(".,;)"))), True
        else:
            yield m.start(), m.end(), False
    yield from _bare(text, at, len(text))


def _bare(text: str, start: int, end: int) -> Iterator[tuple[int, int, bool]]:
    for m in _BARE.finditer(text, start, end):
        n = len(m[0].rstrip(".,:"))
        if n >= MIN_LENGTH:
            yield m.start(), m.start() + n, False


def features(text: str, start: int, end: int, assigned: bool) -> list[float]:
    s = text[start:end]
    n = max(1, len(s))
    kind = [0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3 for c in s]
    share = [kind.count(k) / n for k in range(4)]
    letters = s.lower()
    covered, at = 0, 0
    while at < len(letters):
        w = next((w for w in _by_first().get(letters[at], ()) if letters.startswith(w, at)), None)
        covered += len(w) if w else 0
        at += len(w) if w else 1
    before = [w.lower() for w in _NEAR.findall(text[max(0, start - 48) : start])[-3:]]
    near = before + [w.lower() for w in _NEAR.findall(text[end : end + 24])[:1]]
    runs = re.findall(r"[A-Za-z]+", s)
    return [
        min(n, 200), sum(a != b for a, b in zip(kind, kind[1:])) / n, *share, float(re.fullmatch(r"[0-9a-fA-F]+", s) is not None),
        -sum(c / n * math.log2(c / n) for c in Counter(s).values()), covered / n, s.count("/"), s.count("."), s.count(":") + s.count("-"),
        float(assigned), float(any(k in w for w in before for k in KEYWORDS)), float(any(w in _HARMLESS for w in near)), float(share[0] == 1), float("@" in s), float(s.startswith("-----BEGIN")),
        float(share[1] == 0 or share[2] == 0), max(map(len, runs), default=0) / n,
        float(s.startswith(PREFIXES)), sum(c in "aeiou" for c in letters) / max(1, sum(map(len, runs))), max(map(len, re.findall(r"[bcdfghjklmnpqrstvwxz]+", letters)), default=0), sum(a == 2 and b == 1 for a, b in zip(kind, kind[1:])) / n,
    ]


@cache
def _by_first() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for w in sorted(DICTIONARY, key=len, reverse=True):
        out.setdefault(w[0], []).append(w)
    return out


def labelled_findings(n: int = 4000, seed: int = 11) -> list[tuple[str, int, int, int]]:
    """At most ``n`` labelled findings from formats: keys and passwords (1), look-alikes (0)."""
    rng = random.Random(seed)
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    hexs, upper, mixed = "0123456789abcdef", string.ascii_uppercase + string.digits, string.ascii_letters + string.digits
    b64 = lambda k: base64.b64encode(rng.randbytes(k)).decode()
    syllables = ("an", "er", "the", "ou", "in", "tion", "st", "on", "re", "ed", "es", "ly", "ha", "nd", "que", "en", "de")
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    foreign = syllables + ("sch", "heit", "keit", "ung", "ver", "pf", "aux", "eau", "ment", "que", "lich", "tz", "ein", "os", "mente", "cion", "ge", "ber")
    long = lambda: "".join(rng.choice(foreign) for _ in range(rng.randint(5, 10)))
    letters = string.ascii_letters
    secret = (
        lambda: ("", "AKIA" + pick(upper, 16)), lambda: ("", "ghp_" + pick(mixed, 36)), lambda: ("", "sk_live_" + pick(mixed, 24)), lambda: ("", "xoxb-" + pick(string.digits, 12) + "-" + pick(mixed, 24)),
        lambda: ("password=", pick(hexs, rng.randint(8, 24))), lambda: ("password: ", pick(mixed + "!#%&", rng.randint(8, 20))), lambda: ('token = "', pick(hexs, rng.choice((32, 40, 64)))), lambda: ("api_key: ", pick(mixed, rng.randint(20, 40))),
        lambda: ("secret = ", b64(rng.randint(18, 36))), lambda: ("Authorization: Bearer ", "ey" + pick(mixed, 30) + "." + pick(mixed, 40) + "." + pick(mixed, 43)), lambda: ("pwd=", pick(mixed, rng.randint(8, 16))), lambda: ("", "-----BEGIN PRIVATE KEY-----\n" + b64(48) + "\n-----END PRIVATE KEY-----"), lambda: ("client_secret=", pick(mixed + "-_", 32)),
        lambda: ("", "AKIA" + pick(string.ascii_uppercase, 16)), lambda: ("", "ghp_" + pick(letters, 36)), lambda: ("", "sk_live_" + pick(letters, 24)), lambda: ("Authorization: Bearer ", "ey" + pick(letters, rng.randint(20, 60))), lambda: ("", pick(letters, rng.randint(24, 48))),
    )
    other = (
        lambda: ("commit ", pick(hexs, 40)), lambda: ("sha256 ", pick(hexs, 64)), lambda: ("md5: ", pick(hexs, 32)), lambda: ("id ", "-".join(pick(hexs, k) for k in (8, 4, 4, 4, 12))), lambda: ("", "4" + pick(string.digits, 15)),
        lambda: ("card ", pick(string.digits, 16)), lambda: ("", f"{word()}.{pick(string.digits, 2)}@mail{rng.randint(1, 9)}.example.com"), lambda: ("", f"https://{word()}.example.com/{word()}/{rng.randint(1, 9999)}"), lambda: ("", f"/usr/local/{word()}/{word()}{rng.randint(1, 99)}.py"),
        lambda: ("", f"20{rng.randint(10, 29)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}T1{rng.randint(0, 9)}:2{rng.randint(0, 9)}:30.000Z"), lambda: ("password=", rng.choice(("changeme", "example", "placeholder", "your-password-here", "null12"))), lambda: ("token: ", rng.choice(("string", "required", "your_token_here", "undefined"))),
        lambda: ("", f"{word()}_{word()}_{word()}_{rng.randint(1, 999)}"), lambda: ("", f"{word()}-{word()}-{word()}-v{rng.randint(1, 9)}.{rng.randint(0, 9)}"), lambda: ("order ", pick(string.digits, rng.randint(16, 20))), lambda: ("ip ", ":".join(pick(hexs, 4) for _ in range(8))),
        lambda: ("", f"{word()}{word()}{word()}{rng.randint(1, 99)}{word()}"), lambda: ("", f"{rng.randint(10, 255)}.{rng.randint(0, 255)}.{rng.randint(100, 255)}.{rng.randint(100, 255)}:8080"), lambda: ("data:image/png;base64,", b64(60)),
        lambda: ("", long()), lambda: ("", long().capitalize()), lambda: ("", long().upper()), lambda: ("", "".join(word().capitalize() for _ in range(rng.randint(3, 6)))), lambda: ("", rng.choice("_-.").join(long()[:9] for _ in range(rng.randint(3, 5)))),
        lambda: ("", "_".join(word().upper() for _ in range(rng.randint(3, 6)))), lambda: ("", f"https://{word()}.example.com/{long()}/{word()}.html"), lambda: ("", f"/{word()}/{word()}/{long()}/{word()}.py"), lambda: ("", f"{long()}@mail.example.com"), lambda: ("", rng.choice("-=_.") * rng.randint(16, 60)),
        lambda: ("", "ey" + long()), lambda: ("bearer ", long()),
        lambda: ("", pick(string.ascii_uppercase, rng.randint(2, 5)) + "".join(word().capitalize() for _ in range(rng.randint(2, 4)))), lambda: ("", f"{word()}{rng.choice('=.')}{word()}.{word().upper()}_{word().upper()}_{word().upper()}"), lambda: ("", f"{word().capitalize()}{word().capitalize()}{rng.choice('.=')}{pick(string.ascii_uppercase, 4)}_{word().upper()}_{word().upper()}"),
    )
    out = []
    for k in range(n):
        before, s = rng.choice(secret if k % 2 else other)()
        lead = " ".join(word() for _ in range(rng.randint(1, 6))) + " " + before
        out.append((lead + s + rng.choice((" " + word(), '" ' + pick(string.digits, 16), "", ". " + word())), len(lead), len(lead) + len(s), k % 2))
    return out


class Forest:
    """Random forest of binary splits by Gini impurity, on bootstrap samples and random features."""

    def __init__(self, trees: int = 40, depth: int = 10, seed: int = 3):
        self.trees, self.depth, self.rng = trees, depth, np.random.default_rng(seed)
        self.nodes: list[np.ndarray] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        some = max(1, round(math.sqrt(x.shape[1])))
        for _ in range(self.trees):
            rows = self.rng.integers(0, len(x), len(x))
            nodes: list[list[float]] = []  # feature (-1: leaf), cut, left, right, share of label 1

            def grow(at: np.ndarray, depth: int) -> int:
                me, mean = len(nodes), y[at].mean()
                nodes.append([-1, 0, 0, 0, mean])
                if depth == self.depth or len(at) < 4 or mean in (0, 1):
                    return me
                best = (1e9, -1, 0.0)
                for f in self.rng.choice(x.shape[1], some, replace=False):
                    order = np.argsort(x[at, f], kind="stable")
                    v, ones = x[at[order], f], np.cumsum(y[at[order]])
                    cut = np.flatnonzero(v[1:] > v[:-1])
                    if not len(cut):
                        continue
                    left, k, total = cut + 1.0, ones[cut], ones[-1]
                    right = len(at) - left
                    gini = k * (1 - k / left) + (total - k) * (1 - (total - k) / right)
                    i = int(gini.argmin())
                    if gini[i] < best[0]:
                        best = (gini[i], int(f), (v[cut[i]] + v[cut[i] + 1]) / 2)
                if best[1] >= 0:
                    low = x[at, best[1]] <= best[2]
                    nodes[me][:2] = best[1], best[2]
                    nodes[me][2] = grow(at[low], depth + 1)
                    nodes[me][3] = grow(at[~low], depth + 1)
                return me

            grow(rows, 0)
            self.nodes.append(np.array(nodes))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for t in self.nodes:
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                f = t[at, 0].astype(int)
                go = np.where(x[np.arange(len(x)), np.maximum(f, 0)] <= t[at, 1], t[at, 2], t[at, 3]).astype(int)
                at = np.where(f < 0, at, go)
            total += t[at, 4]
        return total / len(self.nodes)


def train(findings: list[tuple[str, int, int, int]] | None = None) -> Forest:
    findings = labelled_findings() if findings is None else findings
    x, y = [], []
    for text, start, end, label in findings:
        for lo, hi, assigned in candidates(text):
            if lo < end and hi > start:
                x.append(features(text, lo, hi, assigned))
                y.append(label)
    return Forest().fit(np.array(x, float), np.array(y, float))


def recall(forest: Forest, findings: list[tuple[str, int, int, int]]) -> float:
    """Share of the findings labelled 1 that a judged secret overlaps; one that is no candidate counts as missed."""
    mine = [f for f in findings if f[3]]
    judged = _judged([f[0] for f in mine], forest)
    return sum(any(lo < end and hi > start and s >= 0.5 for lo, hi, _, s in got) for (_, start, end, _), got in zip(mine, judged)) / max(1, len(mine))


def _judged(texts: list[str | None], forest: Forest) -> list[list[tuple[int, int, bool, float]]]:
    found = [[*candidates(t)] if t else [] for t in texts]
    flat = [features(t, *c) for t, cs in zip(texts, found) for c in cs]
    scores = iter(forest.score(np.array(flat, float)).tolist() if flat else ())
    return [[(*c, next(scores)) for c in cs] for cs in found]


def scan(docs: DataFrame, forest: Forest | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every candidate of every whole text: (id_col, start, end (code points), assigned, finding, score,
    is_secret: score >= 0.5). Null and empty texts have none; repeated rows each report theirs."""
    shared = docs.sparkSession.sparkContext.broadcast(forest or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("_i").to_pylist(), batch.column("_t").to_pylist()
            rows = [(i, lo, hi, a, t[lo:hi], s, s >= 0.5) for i, t, got in zip(ids, texts, _judged(texts, shared.value)) for lo, hi, a, s in got]
            cols = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (batch.schema.field("_i").type, pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.float64(), pa.bool_()))], ["_i", "start", "end", "assigned", "finding", "score", "is_secret"])

    src = docs.select(F.col(id_col).alias("_i"), F.col(text_col).cast("string").alias("_t"))
    kind = src.schema["_i"].dataType.simpleString()
    return src.mapInArrow(freeing(run), f"_i {kind}, start long, end long, assigned boolean, finding string, score double, is_secret boolean").withColumnRenamed("_i", id_col)


def redact(docs: DataFrame, forest: Forest | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with every secret in ``text_col`` replaced by REDACTED, and n_chars (where it is a column) set
    for the texts that changed. All rows stay; null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(forest or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            new = []
            for t, got in zip(texts, _judged(texts, shared.value)):
                for lo, hi, _, s in reversed(got):
                    if s >= 0.5:
                        t = t[:lo] + REDACTED + t[hi:]
                new.append(t)
            k = batch.schema.get_field_index(text_col)
            yield batch.set_column(k, batch.schema.field(k), pa.array(new, batch.schema.field(k).type))

    out = docs.mapInArrow(freeing(run), docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(text_col).contains(REDACTED), F.length(text_col).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out
