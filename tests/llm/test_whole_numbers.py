"""Centroids, codes and token counts against brute force in Python's whole numbers and the vocabulary's own library."""

import hashlib
import random
from math import floor, isfinite

import duckdb
import numpy as np
import pytest
import sentencepiece

from siltstone.llm import centroids, queries, token_counts, vector_codes, whole_vectors


def square(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def closest(x, centers):
    return min(range(len(centers)), key=lambda c: (square(x, centers[c]), c))


def refined(points, centers, rounds):
    for _ in range(rounds):
        held = [[] for _ in centers]
        for x in points:
            held[closest(x, centers)].append(x)
        centers = [[sum(col) // len(h) for col in zip(*h)] if h else c for h, c in zip(held, centers)]
    return centers


def usable(rows, dim, scale):
    return [(i, [floor(scale * x) for x in v], label) for i, v, label in rows if v and len(v) == dim and all(x is not None and isfinite(x) for x in v)]


def first_of(rows, key, n):
    by = {}
    for i, q, _ in rows:
        if i is not None:
            raw = np.array(q, "<i4").tobytes()
            by[key(i)] = min(by.get(key(i), (raw, q)), (raw, q))
    return [by[k][1] for k in sorted(by)[:n]]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_clusters(rows, k, rounds, dim, scale):
    good = usable(rows, dim, scale)
    centers = refined([q for _, q, _ in good], first_of(good, lambda i: sha(f"3:{i}"), k), rounds)
    at = [(i, c := closest(q, centers), square(q, centers[c])) for i, q, _ in good]
    own = {c: sum(d for _, e, d in at if e == c) for c in range(len(centers))}
    return sorted(((i, c, d, own[c], sum(own.values()), sha(",".join(map(str, centers[c])))) for i, c, d in at), key=str)


def brute_codes(rows, parts, entries, rounds, dim, scale):
    good, size = usable(rows, dim, scale), dim // parts
    start = first_of(good, lambda i: i, entries)
    cut = lambda q, p: q[p * size : (p + 1) * size]
    books = [refined([cut(q, p) for _, q, _ in good], [cut(q, p) for q in start], rounds) for p in range(parts)]
    out = []
    for i, q, label in good:
        at = [closest(cut(q, p), books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{c:02x}" for c in at), sum(square(cut(q, p), books[p][c]) for p, c in enumerate(at))))
    total = {}
    for _, label, _, e in out:
        total[label] = total.get(label, 0) + e
    digest = sha(",".join(str(x) for b in books for c in b for x in c))
    return sorted(((i, label, code, e, total[label], digest) for i, label, code, e in out), key=str)


def odd_vectors(dim, seed, n=300):
    rng = random.Random(seed)
    rows = [(i, [rng.choice((-1.0, -0.5, 0.0, 0.25, 1.0)) for _ in range(dim)], rng.choice((None, 1, 2, 2, 2, 2))) for i in range(n)]  # ties
    rows += [(i, [float(np.float32(rng.gauss(0, 1))) for _ in range(dim)], 7) for i in range(n, 2 * n)]
    nan = float("nan")
    rows += [rows[5], rows[5], (6, rows[9][1], 1), (None, rows[1][1], None), (None, rows[2][1], 3)]  # repeated, without an id
    rows += [(9001, None, 1), (9002, [], 1), (9003, [nan] * dim, 1), (9004, [None] + [1.0] * (dim - 1), 2), (9005, [float("inf")] + [0.0] * (dim - 1), 2), (9006, [1.0] * (dim + 1), 2), (-4, [0.125] * dim, 2)]
    rng.shuffle(rows)
    return rows


SCHEMA = "vec_id long, embedding array<double>, label int, distance string, code int, q int"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "clash", 0, 0) for r in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize(("k", "dim"), [(8, 64), (5, 3), (400, 4)])
def test_clusters_are_those_of_brute_force(spark, monkeypatch, k, dim):
    rows = odd_vectors(dim, k, 60 if dim == 64 else 150)
    monkeypatch.setattr(centroids, "CELLS", 500)
    got = [tuple(r) for r in centroids.cluster(table(spark, rows), k=k, rounds=3, dim=dim, scale=16).collect()]
    assert sorted(got, key=str) == brute_clusters(rows, k, 3, dim, 16)


def test_screening_keeps_what_float32_cannot_tell():
    rng = np.random.default_rng(1)
    top = whole_vectors.largest(64)
    base = rng.integers(-top, top, 64)
    x = base + rng.integers(-3, 4, (500, 64))
    centers = np.concatenate([base + rng.integers(-3, 4, (20, 64)), rng.integers(-top, top, (5, 64)), [base, base]])
    wrong = (x.astype(np.float32) @ centers.astype(np.float32).T * -2 + (centers.astype(np.float64) ** 2).sum(1).astype(np.float32)).argmin(1)
    want = [min(range(len(centers)), key=lambda c: (sum((int(a) - int(b)) ** 2 for a, b in zip(r, centers[c])), c)) for r in x]
    assert centroids.nearest(x.astype(np.int32), centers).tolist() == want
    assert (wrong != want).mean() > 0.3  # float32 alone is wrong on these
    far = rng.integers(-1000, 1000, (500, 64))
    assert centroids._shortlist(far, far[:50]).sum(1).mean() < 1.05  # and here it decides alone


@pytest.mark.parametrize(("parts", "entries", "dim"), [(8, 16, 64), (2, 40, 6), (1, 1, 2)])
def test_codes_are_those_of_brute_force(spark, parts, entries, dim):
    rows = odd_vectors(dim, entries, 60 if dim == 64 else 200)
    got = [tuple(r) for r in vector_codes.compress(table(spark, rows), parts=parts, entries=entries, rounds=2, scale=32).collect()]
    assert sorted(got, key=str) == brute_codes(rows, parts, entries, 2, dim, 32)


def test_the_tree_gives_what_comparing_all_gives():
    rng = np.random.default_rng(2)
    for size, spread, shape in ((16, 5, 8), (200, 3, 2), (256, 1 << 20, 3), (3, 1, 1), (64, 1, 4)):
        entries, points = rng.integers(-spread, spread + 1, (size, shape)), rng.integers(-spread, spread + 1, (700, shape))
        found = vector_codes.Search(vector_codes.tree(entries), entries, points)
        square_ = ((points[:, None, :] - entries[None]) ** 2).sum(2)
        assert found.at.tolist() == square_.argmin(1).tolist() and found.square.tolist() == square_.min(1).tolist()
        if size == 256:
            assert found.compared < 0.3 * 700 * 256  # whole branches are left out


def test_few_and_no_vectors(spark):
    for rows in ([], [(1, None, 2)], [(None, [1.0] * 64, 1)]):
        assert centroids.cluster(table(spark, rows)).collect() == vector_codes.compress(table(spark, rows)).collect() == []
    two = [(4, [0.5] * 64, None), (2, [-0.5] * 64, None)]
    assert sorted(tuple(r) for r in centroids.cluster(table(spark, two)).collect()) == brute_clusters(two, 8, 10, 64, 1024)
    assert sorted(tuple(r) for r in vector_codes.compress(table(spark, two)).collect()) == brute_codes(two, 8, 16, 6, 64, 4096)
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress(table(spark, [(1, [1.0] * 9, 1)]))
    with pytest.raises(Exception, match="scale the vectors down"):
        centroids.cluster(table(spark, [(1, [1e30] * 64, 1)]))


@pytest.mark.parametrize("name", ["op11_centroid_clusters", "op13_vector_codes"])
def test_queries_match_sql(spark, sf_dir, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = duck.execute(queries.SQL[name])
    cols = [c[0] for c in want.description]
    df = queries.QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(tuple(r) for r in df.select(*cols).collect()) == sorted(want.fetchall())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=token_counts.default_vocabulary())


@pytest.fixture(scope="module")
def counter():
    with open(token_counts.default_vocabulary(), "rb") as f:
        return token_counts.Counter(f.read())


def test_counts_are_the_librarys(library, counter):
    rng = random.Random(4)
    pieces = list(counter.rank)
    letters = "abcdehinrst  \t\n\r\x00étü▁▁<s></s><unk><0x0A>0123456789漢字日本語ゼ\U0001f600́‍.,;#&'\""
    for _ in range(4000):
        text = "".join(rng.choice(letters) if rng.random() < 0.6 else rng.choice(pieces) for _ in range(rng.randrange(40)))
        assert counter.count(text) == len(library.encode(text)), repr(text)


def test_counts_of_documents(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op12_token_counts(spark, sf_dir).collect()}
    want = {i: (len(t.encode()), n := len(library.encode(t)), n > 4096) for i, t in texts.items()}
    assert got == want and any(v[2] for v in want.values())


def test_counts_of_odd_rows(spark, library, monkeypatch):
    texts = [None, "", " ", "\n", "plain words", "plain words", "a" * 50_000, "ab " * 400_000, "日本語" * 3000, "\U0001f600" * 100, " " * 5000]
    rows = [(i if i % 4 else None, t, 9, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, _t string").repartition(2)
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count(df, limit=9).collect())
    assert got == sorted((i or 0, len((t or "").encode()), n := len(library.encode(t or "")), n > 9) for i, t, _, _ in rows)
    assert token_counts.count(df.limit(0)).collect() == []
    monkeypatch.setattr(token_counts, "KEPT", 3)  # forgetting changes no count
    with open(token_counts.default_vocabulary(), "rb") as f:
        few = token_counts.Counter(f.read())
    assert [few.count(t) for t in texts[:6]] == [len(library.encode(t or "")) for t in texts[:6]]
