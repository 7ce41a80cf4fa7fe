"""Operators on pairs against brute force."""

import math
import random

import numpy as np
import pytest

from siltstone.llm import common, embed_dedup, ngram_join


def reach(ids, links):
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def brute_jaccard(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    count = {i: sum(i in p for p in links) for i in ids}
    comp = reach(ids, links)
    return {i: (len(sets[i]), count[i], comp[i]) for i in ids}


def perturbed(seed, families=6, copies=9, words=60):
    rng = random.Random(seed)
    rows = []
    for _ in range(families):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice((4, 12, words, 3 * words)))]
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 5))):
                t[rng.randrange(len(t))] = f"x{rng.randrange(1000)}"
            rows.append(" ".join(t))
    return rows


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components(spark, n, percent):
    texts = perturbed(n) + [None, "", " \t\n", "one", "ONE", "one two", "a b c", "a b c", "é É", "long " * 5000, "the same passage " * 30 + "x", "the same passage " * 30 + "y"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], "doc_id long, text string, component_id string, n long").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["n_links"], r["component_id"]) for r in ngram_join.jaccard_components(df, n=n, percent=percent).collect()}
    assert got == brute_jaccard(rows, n, percent)


def test_blocks_find_what_one_group_finds(spark, monkeypatch):
    rows = list(enumerate(perturbed(1, 2, 25)))
    monkeypatch.setattr(ngram_join, "BLOCK", 4000)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["n_links"], r["component_id"]) for r in ngram_join.jaccard_components(df, n=3, percent=90).collect()}
    assert got == brute_jaccard(rows, 3, 90)


def test_signatures_are_shared_by_all_similar_sets():
    rng = np.random.default_rng(0)
    for percent in (80, 90):
        for size in (1, 2, 5, 9, 10, 19, 20, 57, 200, 1500):
            for _ in range(15):
                a = np.unique(rng.integers(0, 2**63, size, np.uint64))
                b = list(a)
                while True:
                    c = list(b)
                    if rng.random() < 0.5 and len(c) > 1:
                        c.pop(rng.integers(len(c)))
                    else:
                        c.append(np.uint64(rng.integers(0, 2**63)))
                    both = len(set(a.tolist()) & set(map(int, c)))
                    if 100 * both < percent * (len(a) + len(c) - both):
                        break
                    b = c
                b = np.unique(np.array(b, np.uint64))
                sa, sb = ({band: (need, set(sigs.tolist())) for band, need, sigs in ngram_join.signatures(x, percent)} for x in (a, b))
                assert any(len(sa[t][1] & sb[t][1]) >= max(sa[t][0], sb[t][0]) >= 1 for t in sa.keys() & sb.keys())


def test_jaccard_odd_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.jaccard_components(empty).collect() == []
    df = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "A B C")], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["component_id"]) for r in ngram_join.jaccard_components(df).collect()), key=str)
    assert got == [(0, None), (1, 1), (1, 1), (2, 1)]
    kept = ngram_join.keep_representatives(df)
    assert kept.columns == df.columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1]
    assert ngram_join.keep_representatives(empty).collect() == []


def test_repeated_ids_with_different_texts(spark):
    one, two = (" ".join(f"{c}{k}" for k in range(80)) for c in "ab")
    rows = [(5, one, "x", 1), (5, two, "x", 2), (6, one + " end", "y", 3), (7, two + " end", "y", 4), (5, one, "x", 1), (8, "", "z", 5), (8, "", "z", 5), (9, "lone text here", "z", 6), (5, "third text of five", "x", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, n long")
    got = sorted((r["doc_id"], r["n_links"], r["component_id"]) for r in ngram_join.jaccard_components(df, n=5, percent=80).collect())
    assert got == [(5, 0, 5), (5, 1, 5), (5, 2, 5), (5, 2, 5), (6, 2, 5), (7, 1, 5), (8, 0, 8), (8, 0, 8), (9, 0, 9)]
    kept = sorted(tuple(r) for r in ngram_join.keep_representatives(df).collect())
    assert kept == sorted([(5, one, "x", 1), (5, two, "x", 2), (5, "third text of five", "x", 7), (8, "", "z", 5), (8, "", "z", 5), (9, "lone text here", "z", 6)])


def test_tasks_combine_what_they_share(spark, monkeypatch):
    rows = list(enumerate(perturbed(3, 4, 12)))
    monkeypatch.setattr(ngram_join, "CHUNK", 300)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: (r["n_shingles"], r["n_links"], r["component_id"]) for r in ngram_join.jaccard_components(df, n=3, percent=90).collect()}
    assert got == brute_jaccard(rows, 3, 90)


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(1000, 1080)] + [(5, k) for k in range(100, 160)] + [(7, 7), (None, 3)]
    got = {r["id"]: r["component"] for r in common.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    ids = {x for p in links[:-2] for x in p}
    assert got == reach(ids, links[:-2])


def test_e8_decoder_is_nearest():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 2, (300, 8))
    at = embed_dedup.nearest_e8(x)
    assert np.all((2 * at) % 1 == 0) and np.all(at.sum(1) % 2 == 0)
    d = ((x - at) ** 2).sum(1)
    near = ((x[:, None, :] - at[:, None, :] - embed_dedup.minimal_vectors()[None]) ** 2).sum(2).min(1)
    assert len(embed_dedup.minimal_vectors()) == 240 and np.all(d <= near + 1e-9)


def vectors(seed, n=400, dim=64):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for k in range(60):  # pairs at every cosine around the threshold
        c = 0.93 + 0.001 * k
        a = x[k] / np.linalg.norm(x[k])
        o = rng.normal(size=dim)
        o -= (o @ a) * a
        x[n - 1 - k] = c * a + math.sqrt(1 - c * c) * o / np.linalg.norm(o)
    x[100:140] = x[100] + rng.normal(0, 0.01, (40, dim))
    return x


def test_near_duplicates(spark, monkeypatch):
    x = vectors(2)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(1000, None, 0), (1001, [0.0] * 64, 0), (1002, [float("nan")] * 64, 0), (1003, [None] + [1.0] * 63, 0), (1004, [float("inf")] + [1.0] * 63, 0), (1005, [1.0, 2.0], 0), (1006, [2.0, 4.0], 0), (1007, [], 0), (None, x[0].tolist(), 0)]
    df = spark.createDataFrame(rows + odd + [rows[0]], "vec_id long, embedding array<double>, kept int")
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    out = embed_dedup.near_duplicates(df).collect()
    assert len(out) == len(rows) + len(odd) + 1
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in out if r["vec_id"] is not None}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    links = [(a, b) for a in range(len(u)) for b in range(a) if u[a] @ u[b] >= 0.95]
    comp = reach(range(len(u)), links)
    found = sum(got[i][0] for i in range(len(u))) / 2
    assert len(links) * 0.98 <= found <= len(links)
    assert sum(got[i][1] == comp[i] for i in comp) >= 0.98 * len(comp)
    for i in (1000, 1001, 1002, 1003, 1004, 1007):
        assert got[i] == (0, i, True)
    assert got[1005] == (1, 1005, True) and got[1006] == (1, 1005, False)
    assert embed_dedup.near_duplicates(df.limit(0)).collect() == []
