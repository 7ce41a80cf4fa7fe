"""The pipeline's stages: columns, order, that each stage's decisions take effect, and rows that aren't as they should be."""

import random

import pytest

import corpus_pipeline
from siltstone.llm import common, ngram_join, secret_scan

DOCS = "doc_id long, text string, lang string, source string, n_chars int, score string, key string, topic string, weight int, _row string"


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "secrets", "mixing", "tokens"]
    kept = docs
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf_dir)
        assert kept.columns == docs.columns, name
        kept = kept.cache()
        counts.append(kept.count())
        if name == "near_copies":
            assert ngram_join.jaccard_components(kept, n=5, percent=80).where("n_links > 0").count() == 0
        if name == "secrets":
            assert secret_scan.scan(kept).where("is_secret").count() == 0
    assert counts[0] >= counts[1] > counts[2] == counts[3] > counts[4] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir)
    assert last.count() == counts[4]


def _tables(spark, path, rows, labels):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_odd_rows_pass_all_stages(spark, tmp_path):
    rng = random.Random(2)
    plain = ["".join(rng.choice(("an", "er", "the", "in", "tion", "ou", "st", "re")) for _ in range(rng.randint(1, 4))) for _ in range(500)]
    said = lambda n: " ".join(rng.choice(plain) for _ in range(n))
    rows = [(i, said(60) + (" moron scumbag loser" if i % 5 == 0 else ""), "en", rng.choice(("a", "b")), 9, "s", "k", "t", 7, "r") for i in range(400)]
    rows += [rows[1], rows[1], (401, rows[2][1] + " end", "en", "a", 9, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None), (402, None, "en", None, None, None, None, None, None, None), (403, "", None, "a", 0, None, None, None, None, None), (404, said(30_000) + " password=b7db7aa4a5fcc78305", "en", "a", 9, "s", "k", "t", 7, "r"), (1, said(50), "en", "b", 9, "s", "k", "t", 7, "r")]
    labels = [(i, 1, int(i % 5 == 0)) for i in range(400)] + [(None, None, 1), (402, 1, None), (401, None, 0)]
    where = _tables(spark, tmp_path, rows, labels)
    docs = spark.read.parquet(f"{where}/documents.parquet")
    kept, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, where)
        assert kept.columns == docs.columns, name
        kept = kept.cache()
        seen[name] = kept.collect()
    clean = {r["doc_id"] for r in seen["toxicity"]}
    assert sum(i in clean for i in range(0, 400, 5)) <= 4 and sum(i in clean for i in range(400) if i % 5) >= 316 and {None, 402, 403, 404} <= clean
    ids = [r["doc_id"] for r in seen["near_copies"]]
    assert ids.count(1) == 2 and 401 not in ids and {None, 402, 403, 404} <= set(ids), "copies of a text stay once, other texts of the id too"
    long = next(r for r in seen["secrets"] if r["doc_id"] == 404)
    assert "b7db7aa4a5fcc78305" not in long["text"] and len(long["text"]) > 30_000 and (long["key"], long["topic"], long["weight"]) == ("k", "t", 7)
    assert len(seen["secrets"]) == len(ids) and 0 < len(seen["mixing"]) <= len(ids)
    assert all((r["topic"], r["weight"]) in (("t", 7), (None, None)) for r in seen["mixing"])
    assert corpus_pipeline.STAGES[-1][1](spark, kept, where).count() == len(seen["mixing"])


def test_columns_without_an_order_pass_all_stages(spark, tmp_path):
    said = lambda k: " ".join(f"w{(k * 31 + j * 7) % 997}" for j in range(60))
    nested = lambda k: ({"a": k, "b": None}, [{"x": [1, k]}, None], bytearray([0, k % 256]), ({"m": {1: k}}, "t"))
    rows = [(k, said(k) + (" moron scumbag loser" if k % 4 == 0 else ""), "en", "a", 9, *nested(k)) for k in range(80)]
    rows += [rows[1], rows[1], (1, rows[1][1], "en", "a", 9, *nested(99)), (1, said(500), "en", "a", 9, *nested(5)), (2, "", "en", "a", 0, None, None, None, None), (2, "", "en", "a", 0, *nested(7))]
    kinds = "doc_id long, text string, lang string, source string, n_chars int, m map<string,int>, n array<map<string,array<int>>>, b binary, s struct<p:struct<m:map<int,int>>,q:string>"
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path)).cache()
        assert kept.schema == docs.schema or kept.columns == docs.columns, name
        if name == "near_copies":
            own = [r for r in kept.collect() if r["doc_id"] in (1, 2)]
            assert sorted((r["doc_id"], r["text"] == rows[1][1]) for r in own) == sorted([(1, True), (1, False), (2, False), (2, False), (2, False)])
            assert next(r["m"] for r in own if r["text"] == rows[1][1]) == {"a": 1, "b": None}  # the least of the rows that repeat it
    assert corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path)).count() == kept.count() > 0


def test_empty_tables_pass_all_stages(spark, tmp_path):
    where = _tables(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, where).collect() == []


def test_broadcasts_are_bounded_in_rows_and_bytes(spark):
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    few = spark.createDataFrame([(1, "x" * 100)] * 20, "a long, t string")
    assert hinted(common.sized(few)) and not hinted(common.sized(few, rows=10)) and not hinted(common.sized(few, size=2000))


def test_stashed_tables_go_with_their_scope(spark):
    with common.scratch():
        kept = common.stash(spark.range(5).toDF("id"))
        assert kept.count() == 5
    with pytest.raises(Exception):
        spark.read.parquet(kept._stash_path).count()


def test_a_cluster_without_a_shared_folder_is_refused():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
