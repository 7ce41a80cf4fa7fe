"""Small sources: settings, question files, column aliases of a SELECT, read-only SQL, and cached embeddings."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.tasks import load_records

# Columns that a source always has.
INTRINSIC_COLUMNS = ("call_id", "calllog_id", "id", "source_record_id", "customer_id", "client_id", "account_id", "company_id", "account_name", "contact_detail", "company_name", "customer_name", "date", "call_event_date", "call_date", "started_at", "created_at", "transcript", "calllog_result")


def parse_settings(text: str) -> dict[str, str]:
    """KEY=VALUE lines: ``export`` is passed over, quotes are taken off, `` #`` begins a comment outside quotes."""
    out = {}
    for line in text.splitlines():
        m = re.fullmatch(r"\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*", line)
        if not m:
            continue
        quoted = re.match(r"(['\"])(.*?)\1\s*(?:#.*)?$", m[2])
        out[m[1]] = quoted[2] if quoted else re.sub(r"(^|\s+)#.*$", "", m[2])
    return out


def load_settings(path: str) -> dict[str, str]:
    """Settings of a file put into the environment where it has none of that name; what was put there."""
    with open(path, encoding="utf-8") as f:
        new = {k: v for k, v in parse_settings(f.read()).items() if k not in os.environ}
    os.environ.update(new)
    return new


def parse_queries(text: str, suffix: str = ".txt") -> list[str]:
    """Questions of a text (one a line, # for comments), JSON or JSONL file, in order, each once."""
    if suffix in (".json", ".jsonl"):
        found = [str(r.get("query", "")).strip() for r in load_records(text)]
    else:
        found = [line.strip() for line in text.splitlines() if not line.lstrip().startswith("#")]
    return list(dict.fromkeys(q for q in found if q))


def collect_queries(lines: Iterable[str], stop: tuple[str, ...] = ("", "quit", "exit")) -> Iterator[str]:
    """Questions from a conversation, until a blank line or a word that ends it."""
    for line in lines:
        if line.strip().lower() in stop:
            return
        yield line.strip()


def observed_columns(sql: str) -> list[str]:
    """What a source's SELECT names its columns, with those that every source has."""
    return sorted({*INTRINSIC_COLUMNS, *(m.lower() for m in re.findall(r"\bAS\s+[`\"]?([A-Za-z_][A-Za-z0-9_]*)", sql, re.IGNORECASE))})


_READS = frozenset("Project Filter Aggregate Join Sort GlobalLimit LocalLimit Limit Offset Distinct Union Intersect Except SubqueryAlias UnresolvedRelation WithCTE CTERelationDef CTERelationRef UnresolvedWith UnresolvedHaving Having Window WithWindowDefinition UnresolvedInlineTable LocalRelation OneRowRelation Generate LateralJoin Pivot Unpivot UnresolvedSubqueryColumnAliases Tail Sample Deduplicate".split())


def run_sql(spark: SparkSession, sql: str, tables: dict[str, DataFrame]) -> DataFrame:
    """One SELECT over the given tables only. The statement is judged by its parsed plan: every node must be one that reads, every relation a given
    table or a CTE. Anything else is a ValueError before anything runs."""
    if re.search(r"\b(java_method|reflect|try_reflect)\s*\(", sql, re.IGNORECASE):
        raise ValueError("functions that call Java are not allowed")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:  # noqa: BLE001  a parser's error of the JVM
        raise ValueError(f"not a statement: {sql!r}") from e
    names: set[str] = set()
    ctes: set[str] = set()

    def walk(node) -> None:
        kind = node.nodeName()
        if kind not in _READS:
            raise ValueError(f"only SELECT is allowed: {kind}")
        if kind == "UnresolvedRelation":
            names.add(node.name())
        if kind == "UnresolvedWith":
            pairs = node.cteRelations()
            for k in range(pairs.size()):
                ctes.add(pairs.apply(k)._1())
                walk(pairs.apply(k)._2())
        for seq in (node.children(), node.subqueries()):
            for k in range(seq.size()):
                walk(seq.apply(k))

    walk(plan)
    if strange := sorted(n for n in names - ctes if n not in tables):
        raise ValueError(f"tables not allowed: {strange}")
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql)


def embedded(client: Callable[[list[str]], list[list[float]]], docs: DataFrame, batch: int = 64, id_col: str = "chunk_id", text: str = "embedding_text") -> DataFrame:
    """(id, document_hash, embedding) by a client on the executors, ``batch`` texts a request. A reply of another length is an error."""
    src = docs.select(F.col(id_col).cast("string").alias("id"), F.sha2(text, 256).alias("document_hash"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, batch):
                part = b.slice(lo, batch)
                got = client(part.column("text").to_pylist())
                if len(got) != part.num_rows:
                    raise ValueError("an embedding client must give one vector per text")
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("document_hash"), pa.array(got, pa.list_(pa.float64()))], ["id", "document_hash", "embedding"])

    return src.mapInArrow(run, "id string, document_hash string, embedding array<double>").withColumnRenamed("id", id_col)


def cached_embeddings(client: Callable[[list[str]], list[list[float]]], model: str, docs: DataFrame, path: str, id_col: str = "chunk_id", text: str = "embedding_text") -> DataFrame:
    """Embeddings of ``docs`` by a table under ``path``, keyed by model and text: only texts that the table doesn't have are embedded, and added."""
    spark, at = docs.sparkSession, f"{path}/model={re.sub('[^A-Za-z0-9._-]+', '_', model)}"
    where = spark._jvm.org.apache.hadoop.fs.Path(at)
    kinds = "document_hash string, embedding array<double>"
    have = lambda: spark.read.schema(kinds).parquet(at) if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where) else spark.createDataFrame([], kinds)
    told = docs.select(id_col, F.col(text).alias("_text"), F.sha2(text, 256).alias("document_hash"))
    new = told.join(have(), "document_hash", "left_anti").dropDuplicates(["document_hash"])
    if new.take(1):
        embedded(client, new, id_col=id_col, text="_text").select("document_hash", "embedding").write.mode("append").parquet(at)
    return told.select(id_col, "document_hash").join(have(), "document_hash").select(id_col, "embedding")

