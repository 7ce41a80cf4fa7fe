"""The driver's tables bound to the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions.text import ENGLISH_STOPWORDS
from siltstone.schemas import Catalog, FieldSpec
from siltstone.sources.calls import gathered, turns_table

SILVER = Catalog.of(
    FieldSpec("status", "enum", allowed_values=("F", "O", "P")),
    FieldSpec("priority", "enum", allowed_values=("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")),
    FieldSpec("segment", "string"),
    FieldSpec("total", "string"),
    FieldSpec("big", "boolean"),
    FieldSpec("flags", "list", allowed_values=("A", "N", "R")),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def silver(spark: SparkSession, sf_dir: str, flags: bool = False, segment: bool = False) -> DataFrame:
    """Orders as silver rows; the list field and the segment are joined only where asked for."""
    out = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("call_id"), F.col("o_orderkey").alias("ordinal"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("total"), (F.col("o_totalprice") > 150000).alias("big"), F.col("o_custkey").alias("custkey"),
    )
    if flags:
        own = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("ordinal")).agg(F.array_sort(F.collect_set("l_returnflag")).alias("flags"))
        out = out.join(own, "ordinal", "left")
    if segment:
        out = out.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_mktsegment").alias("segment")), "custkey", "left")
    return out


SILVER_SQL = """silver AS (
    SELECT CAST(o_orderkey AS VARCHAR) AS call_id, o_orderkey AS ordinal, strftime(o_orderdate, '%Y-%m-%d') AS date,
           o_orderstatus AS status, o_orderpriority AS priority, o_totalprice AS total, o_totalprice > 150000 AS big,
           f.flags, c_mktsegment AS segment
    FROM orders LEFT JOIN (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS flags FROM lineitem GROUP BY 1) f ON f.l_orderkey = o_orderkey
    LEFT JOIN customer ON c_custkey = o_custkey)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns_table(table(spark, sf_dir, "conversations"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gathered(turns(spark, sf_dir))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as search documents: one chunk per call."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("ordinal"), F.col("doc_id").alias("chunk_id"), F.col("doc_id").cast("string").alias("call_id"), "text", F.col("text").alias("bm25_text"), "lang")


STOP_SQL = "(" + ", ".join(f"'{w}'" for w in ENGLISH_STOPWORDS) + ")"
#: Tokens of a text in SQL: lower case, possessives cut, one letter and stop words out.
TOKENS_SQL = f"list_filter(list_transform(regexp_extract_all(replace(lower({{0}}), '_', ' '), '[a-z0-9]+(?:''[a-z]+)?'), lambda t: regexp_replace(t, '''s$', '')), lambda t: length(t) >= 2 AND t NOT IN {STOP_SQL})"


def followers(rows: DataFrame, group: str, value: str, order: str = "ordinal", block: int = 10_000) -> DataFrame:
    """(group, value, order, next): ``value`` of the next row of the group by the whole number ``order`` (distinct within a group), null for its last.

    A group is sorted in blocks of the order's range, so a task holds at most ``block`` rows of it however large it is; what is
    sorted as one is a row for each block. A null group is a group."""
    ids = rows.select(group, value, order, F.floor(F.col(order) / block).alias("_block"))
    firsts = ids.groupBy(group, "_block").agg(F.min_by(value, order).alias("_first"))
    after = firsts.select(F.col(group).alias("_group"), F.col("_block").alias("_at"), F.lead("_first").over(Window.partitionBy(group).orderBy("_block")).alias("_after"))
    within = ids.withColumn("next", F.lead(value).over(Window.partitionBy(group, "_block").orderBy(order)))
    found = within.join(after, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_block") == F.col("_at")), "left")
    return found.select(group, value, order, F.coalesce("next", "_after").alias("next"))


def tokens_sql(column: str) -> str:
    return TOKENS_SQL.replace("{0}", column)


#: Conversations packed into chunks of 900 characters, in SQL.
CHUNKS_SQL = """t AS (SELECT CAST(conv_id AS VARCHAR) AS call_id, CAST(turn + 1 AS INTEGER) AS i, role, trim(text) AS text,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE trim(text) <> ''),
    p AS (SELECT call_id, i, role, text, rn, CAST(1 AS BIGINT) AS chunk, CAST(length(text) AS BIGINT) AS chars FROM t WHERE rn = 1
          UNION ALL
          SELECT t.call_id, t.i, t.role, t.text, t.rn, CASE WHEN p.chars + length(t.text) > 900 THEN p.chunk + 1 ELSE p.chunk END,
                 CASE WHEN p.chars + length(t.text) > 900 THEN length(t.text) ELSE p.chars + length(t.text) END
          FROM p JOIN t ON t.call_id = p.call_id AND t.rn = p.rn + 1),
    chunks AS (SELECT call_id || ':chunk-' || lpad(CAST(chunk AS VARCHAR), 3, '0') AS chunk_id, call_id, CAST(chunk AS INTEGER) AS chunk_index, min(i) AS turn_start, max(i) AS turn_end,
                      list_sort(list(DISTINCT role)) AS speaker_set, string_agg('turn:' || i || ' speaker:' || role || ': ' || text, chr(10) ORDER BY i) AS text
               FROM p GROUP BY call_id, chunk)"""
