"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import glob
import os
import re

import duckdb
import pytest

from siltstone.plans import registry


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def _rounded(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_matches_sql(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    got = df.collect()
    if name not in registry.SQL:
        return
    r = duck.execute(registry.SQL[name])
    cols = [c[0] for c in r.description]
    assert sorted(cols) == sorted(df.columns)
    expected = sorted(str(tuple(_rounded(v) for v in row)) for row in r.fetchall())
    assert sorted(str(tuple(_rounded(row[c]) for c in cols)) for row in got) == expected


def test_labels_are_those_of_whole_texts(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["chunk_id"]: r["value"] for r in registry.QUERIES["normalize_label"](spark, sf_dir).collect()}
    assert got == {i: re.sub("[^a-z0-9]+", "_", t.strip(" ").lower()).strip("_") for i, t in texts.items()}
    assert max(map(len, got.values())) > 1000


def test_operators_that_sql_can_say_are_registered(spark):
    assert {"sentence_labels", "system_mentions", "source_counts", "pass_rate", "loop_summary", "records_for_chunks"} <= set(registry.SQL)
    rows = spark.createDataFrame([(0, "We need the Acme dashboard now. Sunny day! Asked Jira")], "ordinal int, text string")
    assert {r["label"]: r["count"] for r in registry.inference.sentence_labels(rows).collect()} == {"acme_dashboard_now": 1, "acme": 1, "dashboard": 1, "now": 1, "asked_jira": 1, "asked": 1, "jira": 1}


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
