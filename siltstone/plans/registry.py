"""Queries over the driver's tables, one or more per operator, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import tables
from siltstone.functions import text as tx
from siltstone.operators import aggregates, chunking, feedback, filters, inference, negotiation, retrieval, tasks
from siltstone.operators import silver as sv
from siltstone.operators.search_index import SearchIndex
from siltstone.plans import agent, loop, planner, views
from siltstone.plans.batches import Batches
from siltstone.plans.tracing import Tracer
from siltstone.plans.views import CHUNKS_SQL, SILVER, SILVER_SQL, tokens_sql
from siltstone.schemas import Catalog, FieldSpec
from siltstone.sources import calls, variants
from siltstone.sources.shared import shared_folder, state_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


# ---- filters -----------------------------------------------------------------------------------

_IDS = ("call_id", "status", "priority")


def _filter(name: str, given: dict, where: str, flags: bool = False, limit: int | None = None, **more) -> None:
    def run(spark, d):
        return filters.query_silver(views.silver(spark, d, flags=flags, **more), filters.validate_filters(given, SILVER) if name != "filter_scalar_vs_list_false" else given, limit).select(*_IDS)

    add(name, run, f"WITH {SILVER_SQL} SELECT call_id, status, priority FROM silver WHERE {where}" + (f" ORDER BY ordinal LIMIT {limit}" if limit else ""))


_filter("filter_scalar_eq", {"status": "F"}, "status = 'F'")
_filter("filter_list_contains", {"flags": "R"}, "coalesce(list_contains(flags, 'R'), false)", flags=True)
_filter("filter_list_overlap", {"flags": ["A", "R"]}, "coalesce(list_has_any(flags, ['A', 'R']), false)", flags=True)
_filter("filter_bool", {"big": "true"}, "big")
_filter("filter_conjunction_limit", {"status": "O", "flags": "N", "big": False}, "status = 'O' AND coalesce(list_contains(flags, 'N'), false) AND NOT big", flags=True, limit=50)
_filter("filter_scalar_vs_list_false", {"status": ["F", "O"]}, "false")
add(
    "filter_null_safe",
    lambda s, d: filters.query_silver(views.silver(s, d).withColumn("status", F.nullif("status", F.lit("P"))), {"status": None}).select("call_id", "priority"),
    f"WITH {SILVER_SQL} SELECT call_id, priority FROM silver WHERE status = 'P'",
)

# ---- aggregate expressions ---------------------------------------------------------------------


def _agg(name: str, expression: str, columns: dict[str, str], sql: str, flags: bool = False, segment: bool = False) -> None:
    def run(spark, d):
        got = aggregates.evaluate(expression, views.silver(spark, d, flags=flags, segment=segment), SILVER).frame
        if "record_ids" in got.columns:
            got = got.withColumn("record_ids", F.array_join("record_ids", ","))
        return got.select(*[F.col(c).cast(t).alias(c) for c, t in columns.items()])

    add(name, run, f"WITH {SILVER_SQL} {sql}")


_KC = {"key": "string", "count": "bigint"}
_agg("agg_count", "count(records)", {"result": "bigint"}, "SELECT count(*) AS result FROM silver")
_agg("agg_group_count_scalar", "group_count(records, 'priority')", _KC, "SELECT priority AS key, count(*) AS count FROM silver WHERE priority NOT IN ('', 'not_mentioned') GROUP BY 1")
_agg("agg_group_count_list", "group_count(records, 'flags')", _KC, "SELECT key, count(*) AS count FROM (SELECT unnest(flags) AS key FROM silver) GROUP BY 1", flags=True)
_agg("agg_group_count_bool", "group_count(records, 'big')", _KC, "SELECT 'True' AS key, count(*) AS count FROM silver WHERE big HAVING count(*) > 0")
_agg("agg_top_k_tie", "top_k(records, 'segment', k=3)", _KC, "SELECT segment AS key, count(*) AS count FROM silver WHERE segment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, min(ordinal) LIMIT 3", segment=True)
_agg("agg_nested_group_count", "nested_group_count(records, ['status', 'flags'])", {"key1": "string", "key2": "string", "count": "bigint"}, "SELECT status AS key1, key2, count(*) AS count FROM (SELECT status, unnest(flags) AS key2 FROM silver) GROUP BY 1, 2", flags=True)
_agg("agg_count_if", "count_if(records, 'flags', 'R')", {"result": "bigint"}, "SELECT count(*) AS result FROM silver WHERE list_contains(flags, 'R')", flags=True)
for _name, _op in (("eq", "=="), ("ne", "!="), ("gt", ">"), ("ge", ">="), ("lt", "<"), ("le", "<=")):
    _agg(f"agg_count_where_{_name}", f"count_where(records, 'total', '{_op}', 150000)", {"result": "bigint"}, f"SELECT count(*) AS result FROM silver WHERE total {'=' if _op == '==' else _op} 150000")
_agg("agg_numeric_range", "numeric_range_count(records, 'total', min_value=100000, max_value=200000)", {"count": "bigint", "field": "string", "min": "double", "max": "double", "record_ids": "string"}, "SELECT count(*) AS count, 'total' AS field, CAST(100000 AS DOUBLE) AS min, CAST(200000 AS DOUBLE) AS max, (SELECT string_agg(call_id, ',' ORDER BY ordinal) FROM (SELECT call_id, ordinal FROM silver WHERE total BETWEEN 100000 AND 200000 ORDER BY ordinal LIMIT 20)) AS record_ids FROM silver WHERE total BETWEEN 100000 AND 200000")
_agg("agg_date_range", "date_range_count(records, start='1995-01-01', end='1995-12-31')", {"count": "bigint", "start": "string", "end": "string", "record_ids": "string"}, "SELECT count(*) AS count, '1995-01-01' AS start, '1995-12-31' AS \"end\", (SELECT string_agg(call_id, ',' ORDER BY ordinal) FROM (SELECT call_id, ordinal FROM silver WHERE date BETWEEN '1995-01-01' AND '1995-12-31' ORDER BY ordinal LIMIT 20)) AS record_ids FROM silver WHERE date BETWEEN '1995-01-01' AND '1995-12-31'")
for _grain, _n in (("day", 10), ("month", 7), ("year", 4)):
    _agg(f"agg_cohort_{_grain}", f"cohort_count(records, '{_grain}')", _KC, f"SELECT left(date, {_n}) AS key, count(*) AS count FROM silver WHERE date IS NOT NULL GROUP BY 1")
_agg("agg_ratio", "ratio(count_if(records, 'status', 'F'), count(records))", {"numerator": "bigint", "denominator": "bigint", "ratio": "double"}, "SELECT count(*) FILTER (status = 'F') AS numerator, count(*) AS denominator, round(CAST(count(*) FILTER (status = 'F') AS DOUBLE) / count(*), 4) AS ratio FROM silver")
_agg("agg_distinct_via_count_group", "count(group_count(records, 'priority'))", {"result": "bigint"}, "SELECT count(DISTINCT priority) AS result FROM silver")


def _evidence(spark, d):
    rows = views.silver(spark, d, flags=True).withColumn("evidence_refs", F.create_map(F.lit("status"), F.array(F.concat(F.lit("chunk:s"), "status")), F.lit("flags"), F.transform("flags", lambda x: F.concat(F.lit("chunk:f"), x))))
    return aggregates.evidence_refs(rows, ["flags", "status"], limit=4).select("ref", F.col("ordinal").alias("first_row"))


add("agg_evidence_refs", _evidence, f"WITH {SILVER_SQL}, r AS (SELECT ordinal, 0 AS f, u.p, 'chunk:f' || u.x AS ref FROM silver, (SELECT unnest(flags) AS x, generate_subscripts(flags, 1) AS p) u UNION ALL SELECT ordinal, 1, 1, 'chunk:s' || status FROM silver) SELECT ref, first_row FROM (SELECT ref, min((ordinal, f, p)) AS k, min(ordinal) AS first_row FROM r GROUP BY 1 ORDER BY k LIMIT 4)")

# ---- ingest ------------------------------------------------------------------------------------

add("turns_normalize", lambda s, d: views.turns(s, d).select("call_id", "turn_index", "speaker", "text"), "SELECT CAST(conv_id AS VARCHAR) AS call_id, CAST(turn + 1 AS INTEGER) AS turn_index, coalesce(role, 'unknown') AS speaker, trim(text) AS text FROM conversations WHERE trim(text) <> ''")
add("json_props_extract", lambda s, d: views.table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k")), "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
add("snippet", lambda s, d: views.documents(s, d).select("chunk_id", tx.snippet("text").alias("snippet")), r"SELECT doc_id AS chunk_id, CASE WHEN length(c) <= 220 THEN c ELSE rtrim(left(c, 217)) || '...' END AS snippet FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS c FROM documents)")
add("chunk_pack", lambda s, d: chunking.pack(views.calls(s, d)).select("chunk_id", "call_id", "chunk_index", "turn_start", "turn_end", F.length("text").cast("bigint").alias("char_count")), f"WITH RECURSIVE {CHUNKS_SQL} SELECT chunk_id, call_id, chunk_index, turn_start, turn_end, CAST(length(text) AS BIGINT) AS char_count FROM chunks")
add("chunk_rows", lambda s, d: chunking.pack(views.calls(s, d)).select("chunk_id", F.array_join("speaker_set", ",").alias("speakers"), "text"), f"WITH RECURSIVE {CHUNKS_SQL} SELECT chunk_id, array_to_string(speaker_set, ',') AS speakers, text FROM chunks")

# ---- text --------------------------------------------------------------------------------------


def _text(name: str, column, sql: str) -> None:
    add(name, lambda s, d: views.documents(s, d).select("chunk_id", column().alias("value")), f"SELECT doc_id AS chunk_id, {sql} AS value FROM documents")


_SCHEMA_STOP = "(" + ", ".join(f"'{w}'" for w in tx.SCHEMA_STOPWORDS) + ")"
_QUERY_STOP = "(" + ", ".join(f"'{w}'" for w in tx.QUERY_STOPWORDS) + ")"
_SEARCH_STOP = "(" + ", ".join(f"'{w}'" for w in tx.SEARCH_STOPWORDS) + ")"
_LABEL_SQL = "regexp_replace(regexp_replace(lower(trim({0})), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
_CONTENT_SQL = "list_filter(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_-]{2,}'), lambda w: " + _LABEL_SQL.replace("{0}", "w") + f"), lambda w: length(w) >= 3 AND w NOT IN {_SCHEMA_STOP})"
_text("tokenize", lambda: F.array_join(tx.english_tokens("text"), " "), f"array_to_string({tokens_sql('text')}, ' ')")
_text("normalize_label", lambda: tx.normalize_label("text"), _LABEL_SQL.replace("{0}", "text"))
_text("normalize_identifier", lambda: tx.normalize_identifier(F.concat(F.col("ordinal").cast("string"), F.lit(" - "), F.col("lang"))), "'field_' || " + _LABEL_SQL.replace("{0}", "CAST(doc_id AS VARCHAR) || ' - ' || lang"))
_text("content_tokens", lambda: F.array_join(tx.content_tokens("text"), " "), f"array_to_string({_CONTENT_SQL}, ' ')")
_text("lexical_terms", lambda: F.array_join(F.array_sort(tx.lexical_terms("text")), " "), f"array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda w: length(w) >= 3 AND w NOT IN {_SEARCH_STOP}))), ' ')")
_text("hash_ids", lambda: tx.short_hash("text", 16), "left(sha256(text), 16)")
add("bigram_counts", lambda s, d: inference.label_counts(views.documents(s, d)).select("label", "count").orderBy(F.desc("count"), "label").limit(200), f"WITH t AS (SELECT {_CONTENT_SQL} AS t FROM documents), e AS (SELECT unnest(t) AS label FROM t UNION ALL SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i] || '_' || t[i + 1])) FROM t WHERE len(t) > 1) SELECT label, count(*) AS count FROM e GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 200")

_TRIGGERS = ("license", "copyright", "loser", "trash", "stupid", *inference.NEED_TERMS)
_NEED = "[" + ", ".join(f"'{w}'" for w in _TRIGGERS) + "]"
_SYSTEMS = "(" + ", ".join(f"'{w}'" for w in inference.SYSTEM_HINTS) + ")"
#: Word ends as in Spark, where letters beyond ASCII are letters too.
_ASCII_SQL = r"regexp_replace(regexp_replace(text, '[^\p{L}\p{Nd}\x00-\x7F]', ' ', 'g'), '[^\x00-\x7F]', '_', 'g')"
add("sentence_labels", lambda s, d: inference.sentence_labels(views.documents(s, d), _TRIGGERS), f"WITH s AS (SELECT unnest(regexp_split_to_array(text, '[\n.!?。]+')) AS text FROM documents), t AS (SELECT {_CONTENT_SQL} AS t FROM s WHERE list_has_any(regexp_extract_all(lower(text), '[a-z0-9_]+'), {_NEED})), e AS (SELECT array_to_string(t[1:3], '_') AS label FROM t WHERE len(t) > 0 UNION ALL SELECT unnest(t[1:5]) FROM t) SELECT label, count(*) AS count FROM e GROUP BY 1")
add("system_mentions", lambda s, d: inference.system_mentions(views.documents(s, d)), rf"WITH e AS (SELECT {_LABEL_SQL.replace('{0}', 'w')} AS label, 1 AS w FROM (SELECT unnest(regexp_extract_all({_ASCII_SQL}, '\b[A-Z][A-Za-z0-9]{{2,}}\b')) AS w FROM documents) UNION ALL SELECT label, 2 FROM (SELECT unnest({_CONTENT_SQL}) AS label FROM documents) WHERE label IN {_SYSTEMS}) SELECT label, CAST(sum(w) AS BIGINT) AS score FROM e GROUP BY 1")

# ---- retrieval ---------------------------------------------------------------------------------

_Q = ("thnt ered oned with the", "loser trash stupid", "edation apache license")


def _queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, q) for i, q in enumerate(_Q)], "query_id int, query string")


def _bm25_sql(queries: tuple[str, ...], limit: int, restrict: str = "true") -> str:
    q = " UNION ALL ".join(f"SELECT {i} AS query_id, '{x}' AS query" for i, x in enumerate(queries))
    return f"""WITH d AS (SELECT doc_id AS chunk_id, lang, {tokens_sql("text")} AS tokens FROM documents),
        s AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM d), qs AS ({q}),
        q AS (SELECT DISTINCT query_id, unnest({tokens_sql("query")}) AS term FROM qs),
        p AS (SELECT chunk_id, lang, len(tokens) AS dl, unnest(tokens) AS term FROM d),
        tf AS (SELECT term, chunk_id, any_value(lang) AS lang, any_value(dl) AS dl, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
        c AS (SELECT q.query_id, tf.chunk_id, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / greatest(avgdl, 1.0))), 6) AS part, term
              FROM tf JOIN df USING (term) JOIN q USING (term), s WHERE {restrict}),
        r AS (SELECT query_id, chunk_id, sum(part) AS raw, string_agg(term, ' ' ORDER BY term) AS matched FROM c GROUP BY 1, 2 HAVING sum(part) > 0),
        k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 6) DESC, chunk_id) AS rank FROM r)
        SELECT CAST(query_id AS INTEGER) AS query_id, chunk_id, round(raw, 6) AS score, matched, rank FROM k WHERE rank <= {limit}"""


def _hits(df: DataFrame) -> DataFrame:
    return df.select("query_id", "chunk_id", "score", F.array_join("matched_terms", " ").alias("matched"), F.col("rank").cast("bigint").alias("rank"))


add("bm25_stats", lambda s, d: retrieval.corpus_stats(views.documents(s, d)).select("n", F.round("avgdl", 6).alias("avgdl")), f"SELECT count(*) AS n, round(avg(len({tokens_sql('text')})), 6) AS avgdl FROM documents")
add("bm25_search", lambda s, d: _hits(retrieval.bm25(views.documents(s, d), _queries(s).where("query_id = 0"), 20)), _bm25_sql(_Q[:1], 20))
add("bm25_filtered", lambda s, d: _hits(retrieval.bm25(views.documents(s, d), _queries(s).where("query_id = 0"), 20, views.documents(s, d).where("lang = 'en'").select("chunk_id"))), _bm25_sql(_Q[:1], 20, "tf.lang = 'en'"))
add("bm25_batch_fanout", lambda s, d: _hits(retrieval.bm25(views.documents(s, d), _queries(s), 15)), _bm25_sql(_Q, 15))


def _indexed(spark: SparkSession, d: str) -> SearchIndex:
    """The index of the documents, stored in the shared folder for as long as their files are the same."""
    docs = views.documents(spark, d)
    index = SearchIndex(spark, f"{shared_folder(spark)}/index-{state_of(docs)}")
    index.add(docs, "all")
    return index


def _in_batches(spark: SparkSession, d: str) -> SearchIndex:
    """The same documents in three deliveries, one of them twice and one with documents of another, then merged."""
    docs = views.documents(spark, d)
    index = SearchIndex(spark, f"{shared_folder(spark)}/batches-{state_of(docs)}")
    for name, part in (("b0", "ordinal % 3 = 0"), ("b1", "ordinal % 3 < 2"), ("b0", "ordinal % 3 = 2"), ("b2", "ordinal % 3 > 0")):
        index.add_new(docs.where(part), name)
    index.compact("merged")
    return index


add("bm25_indexed", lambda s, d: _hits(_indexed(s, d).search(_queries(s), 15)), _bm25_sql(_Q, 15))
add("bm25_indexed_filtered", lambda s, d: _hits(_indexed(s, d).search(_queries(s), 20, views.documents(s, d).where("lang = 'en'").select("chunk_id"))), _bm25_sql(_Q, 20, "tf.lang = 'en'"))
add("bm25_incremental", lambda s, d: _hits(_in_batches(s, d).search(_queries(s), 15)), _bm25_sql(_Q, 15))
add("index_frequencies", lambda s, d: _in_batches(s, d).frequencies(), f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({tokens_sql('text')}) AS term FROM documents) GROUP BY 1")
_LEX = ("there", "ation", "lic")
_LEX_SQL = " + ".join(f"CAST(contains(lower(text), '{t}') AS INTEGER)" for t in _LEX)
add("search_lexical", lambda s, d: retrieval.lexical(views.documents(s, d), s.createDataFrame([(0, " ".join(_LEX))], "query_id int, query string"), 25).select("chunk_id", "score", F.col("rank").cast("bigint").alias("rank")), f"SELECT * FROM (SELECT doc_id AS chunk_id, CAST({_LEX_SQL} AS DOUBLE) AS score, row_number() OVER (ORDER BY {_LEX_SQL} DESC, doc_id) AS rank FROM documents WHERE {_LEX_SQL} > 0) WHERE rank <= 25")


def _vector(spark: SparkSession, d: str) -> list[float]:
    return list(views.table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"])


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "embeddings").withColumnRenamed("vec_id", "chunk_id")


def _cosine_sql(where: str = "true") -> str:
    return f"SELECT * FROM (SELECT vec_id AS chunk_id, round(c, 6) AS score, row_number() OVER (ORDER BY c DESC, vec_id) AS rank FROM (SELECT e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS c FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE {where})) WHERE rank <= 10"


add("cosine_search", lambda s, d: retrieval.embedding(_vectors(s, d), _vector(s, d), 10).select("chunk_id", "score", F.col("rank").cast("bigint").alias("rank")), _cosine_sql())
add("cosine_filtered", lambda s, d: retrieval.embedding(_vectors(s, d), _vector(s, d), 10, _vectors(s, d).where("label < 3").select("chunk_id")).select("chunk_id", "score", F.col("rank").cast("bigint").alias("rank")), _cosine_sql("e.label < 3"))


def _zip(spark: SparkSession, d: str) -> DataFrame:
    a = retrieval.bm25(views.documents(spark, d), _queries(spark).where("query_id = 0"), 10)
    b = retrieval.embedding(_vectors(spark, d), _vector(spark, d), 10)
    return retrieval.zipper(a, b, 12).select("chunk_id", F.col("position").cast("bigint").alias("position"))


add("hybrid_zipper", _zip, f"WITH a AS ({_bm25_sql(_Q[:1], 10)}), b AS ({_cosine_sql()}), u AS (SELECT chunk_id, rank, 0 AS src FROM a UNION ALL SELECT chunk_id, rank, 1 FROM b), m AS (SELECT chunk_id, min(rank * 2 + src) AS place FROM u GROUP BY 1) SELECT chunk_id, row_number() OVER (ORDER BY place) AS position FROM m ORDER BY place LIMIT 12")
add("bm25_explain", lambda s, d: retrieval.explain(views.documents(s, d), _queries(s).where("query_id = 2"), retrieval.bm25(views.documents(s, d), _queries(s).where("query_id = 2"), 10)).select("chunk_id", "term", F.col("tf").cast("bigint").alias("tf"), F.col("df").cast("bigint").alias("df"), "contribution"), f"WITH h AS ({_bm25_sql(_Q[2:], 10)}), d AS (SELECT doc_id AS chunk_id, {tokens_sql('text')} AS tokens FROM documents), s AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM d), q AS (SELECT DISTINCT unnest({tokens_sql(repr(_Q[2]))}) AS term), f AS (SELECT term, (SELECT count(*) FROM d WHERE list_contains(tokens, q.term)) AS df FROM q) SELECT h.chunk_id, term, CAST(len(list_filter(tokens, lambda x: x = term)) AS BIGINT) AS tf, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * len(list_filter(tokens, lambda x: x = term)) * 2.2 / (len(list_filter(tokens, lambda x: x = term)) + 1.2 * (0.25 + 0.75 * len(tokens) / greatest(avgdl, 1.0))), 6) AS contribution FROM h JOIN d USING (chunk_id), f, s")
add("fetch_chunks_ordered", lambda s, d: retrieval.fetch(views.documents(s, d).select("chunk_id", tx.snippet("text", 40).alias("snip")), s.createDataFrame([(0, "chunk:7"), (1, "chunk:3"), (2, "chunk:7"), (3, "chunk:-1")], "pos int, ref string").select("pos", "ref")).select("pos", F.col("chunk_id").cast("bigint").alias("chunk_id")), "SELECT CAST(pos AS INTEGER) AS pos, chunk_id FROM (VALUES (0, 7), (1, 3), (2, 7), (3, -1)) v(pos, chunk_id) JOIN documents ON doc_id = chunk_id")

# ---- silver ------------------------------------------------------------------------------------

_RULES = {"licence": ("license", "copyright"), "contact": ("@mail", "example.com"), "insult": ("loser", "idiot", "stupid", "trash"), "table": (" | ",)}
_LEVELS = (("high", ("idiot", "worthless")), ("medium", ("trash", "clown")))


def _extracted(spark: SparkSession, d: str) -> DataFrame:
    docs = views.documents(spark, d)
    calls = docs.select("call_id", "ordinal", F.col("text").alias("transcript"), F.array(F.struct(F.lit(1).alias("turn_index"), F.lit("u").alias("speaker"), "text")).alias("turns"))
    chunks = docs.select("call_id", F.lit(1).alias("chunk_index"), F.col("call_id").alias("chunk_id"), "text")
    return sv.extract(calls, chunks, [sv.list_row("theme", 0, _RULES), sv.enum_row("level", 1, _LEVELS), sv.boolean_row("secret", 2, ("password=", "token ="))])


def _any_sql(terms: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower(text), '{t}')" for t in terms) + ")"


_THEME_SQL = "list_filter([" + ", ".join(f"CASE WHEN {_any_sql(ks)} THEN '{v}' END" for v, ks in _RULES.items()) + "], lambda x: x IS NOT NULL)"
_LEVEL_SQL = f"CASE WHEN {_any_sql(_LEVELS[0][1])} THEN 'high' WHEN {_any_sql(_LEVELS[1][1])} THEN 'medium' ELSE 'not_mentioned' END"
_SECRET_SQL = _any_sql(("password=", "token ="))
add("keyword_extract_list", lambda s, d: _extracted(s, d).where("field_name = 'theme'").select("call_id", F.array_join("value_list", ",").alias("themes"), F.size("evidence_refs").cast("bigint").alias("refs")), f"SELECT CAST(doc_id AS VARCHAR) AS call_id, array_to_string({_THEME_SQL}, ',') AS themes, CAST(least(len({_THEME_SQL}), 1) AS BIGINT) AS refs FROM documents")
add("ordered_rule_enum", lambda s, d: _extracted(s, d).where("field_name = 'level'").select("call_id", F.col("value_str").alias("level")), f"SELECT CAST(doc_id AS VARCHAR) AS call_id, {_LEVEL_SQL} AS level FROM documents")
add("boolean_by_evidence", lambda s, d: _extracted(s, d).where("field_name = 'secret'").select("call_id", F.col("value_bool").alias("secret"), "confidence"), f"SELECT CAST(doc_id AS VARCHAR) AS call_id, {_SECRET_SQL} AS secret, CASE WHEN {_SECRET_SQL} THEN 'high' ELSE 'low' END AS confidence FROM documents")
_QUALITY_SQL = f"""SELECT field_name, sum(CAST(ok AS BIGINT)) AS s, count(*) AS n FROM (SELECT 'theme' AS field_name, len({_THEME_SQL}) > 0 AS ok FROM documents UNION ALL SELECT 'level', {_LEVEL_SQL} <> 'not_mentioned' FROM documents UNION ALL SELECT 'secret', {_SECRET_SQL} FROM documents) GROUP BY 1"""
add("quality_report", lambda s, d: sv.quality(_extracted(s, d), views.documents(s, d)), f"SELECT field_name, CAST(s AS BIGINT) AS support_call_count, round(CAST(s AS DOUBLE) / n, 4) AS fill_rate, CAST(CASE WHEN s > 0 THEN 1 ELSE 0 END AS DOUBLE) AS evidence_coverage, CASE WHEN s > 0 THEN 'promote' ELSE 'hold' END AS status FROM ({_QUALITY_SQL})")


def _pivoted(spark: SparkSession, d: str) -> DataFrame:
    specs = [FieldSpec("theme", "list"), FieldSpec("level", "enum"), FieldSpec("secret", "boolean")]
    return sv.pivot(views.documents(spark, d).select("call_id", "ordinal"), _extracted(spark, d), specs).select("call_id", F.array_join("theme", ",").alias("theme"), "level", "secret", F.array_join("quality_flags", ",").alias("flags"))


add("silver_pivot", _pivoted, f"SELECT CAST(doc_id AS VARCHAR) AS call_id, array_to_string({_THEME_SQL}, ',') AS theme, {_LEVEL_SQL} AS level, {_SECRET_SQL} AS secret, '' AS flags FROM documents")
add("refs_first_k", lambda s, d: sv.with_chunks(views.calls(s, d).select("call_id", "ordinal"), chunking.pack(views.calls(s, d))).select("call_id", F.array_join(sv.refs_for(["the"], 2), ",").alias("refs")), f"WITH RECURSIVE {CHUNKS_SQL} SELECT call_id, coalesce(string_agg('chunk:' || chunk_id, ',' ORDER BY chunk_index) FILTER (hit AND k <= 2), '') AS refs FROM (SELECT *, contains(lower(text), 'the') AS hit, row_number() OVER (PARTITION BY call_id, contains(lower(text), 'the') ORDER BY chunk_index) AS k FROM chunks) GROUP BY 1")

# ---- sets, joins, operations -------------------------------------------------------------------

add("union_distinct_first_wins", lambda s, d: feedback.first_wins([views.documents(s, d).where("lang = 'en'").select("call_id", "ordinal", F.lit("en").alias("src")), views.documents(s, d).select("call_id", "ordinal", F.lit("all").alias("src"))], "call_id", "ordinal").select("call_id", "src"), "SELECT CAST(doc_id AS VARCHAR) AS call_id, CASE WHEN lang = 'en' THEN 'en' ELSE 'all' END AS src FROM documents")
add("dedupe_tasks", lambda s, d: tasks.normalized(views.documents(s, d).select("ordinal", F.col("text").alias("query"))).select("task_id", F.col("ordinal").alias("first_row")), r"SELECT 'task-' || left(sha256(k), 16) AS task_id, min(doc_id) AS first_row FROM (SELECT lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS k, doc_id FROM documents) WHERE k <> '' GROUP BY k")
add("semi_anti_refs", lambda s, d: sv.whitelisted(views.table(s, d, "labels").select(F.col("doc_id").alias("call_id"), F.concat(F.lit("chunk:"), "doc_id").alias("ref")), views.table(s, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("call_id"), F.col("doc_id").alias("chunk_id"))).select(F.col("call_id").alias("doc_id"), "known"), "SELECT doc_id, doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en') AS known FROM labels")
add("left_join_default", lambda s, d: views.table(s, d, "documents").select("doc_id").join(views.table(s, d, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.col("toxic").isNull().alias("missing_field")), "SELECT doc_id, coalesce(quality, -1) AS quality, toxic IS NULL AS missing_field FROM documents LEFT JOIN labels USING (doc_id)")
add("error_histogram", lambda s, d: feedback.error_histogram(views.table(s, d, "events").select(F.array("event_type", F.concat(F.lit("user_"), (F.col("user_id") % 7).cast("string"))).alias("validation_errors"))), "SELECT error, count(*) AS count FROM (SELECT event_type AS error FROM events UNION ALL SELECT 'user_' || CAST(user_id % 7 AS VARCHAR) FROM events) GROUP BY 1")
add("usage_rollup", lambda s, d: feedback.usage_rollup(views.table(s, d, "events").select(F.col("event_type").alias("model"), (F.col("event_id") % 1000).alias("input_tokens"), (F.col("user_id") % 100).alias("output_tokens")), {"click": (2.0, 8.0), "view": (1.0, 4.0)}), "SELECT event_type AS model, count(*) AS calls, CAST(sum(event_id % 1000) AS BIGINT) AS input_tokens, CAST(sum(user_id % 100) AS BIGINT) AS output_tokens, round(CASE event_type WHEN 'click' THEN (2 * sum(event_id % 1000) + 8 * sum(user_id % 100)) / 1000000.0 WHEN 'view' THEN (sum(event_id % 1000) + 4 * sum(user_id % 100)) / 1000000.0 END, 10) AS cost_usd FROM events GROUP BY 1")
add("redact_replay", lambda s, d: feedback.redacted(views.table(s, d, "documents").select("doc_id", "text", "source")), "SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN text ELSE '[redacted]' END AS text, source FROM documents")
add("eval_subset_pass", lambda s, d: tasks.scored(_expected(s, d)).select(F.col("task_id").alias("call_id"), "passed"), f"WITH {SILVER_SQL} SELECT call_id, coalesce(list_has_all(flags, ['N', 'R']), false) AS passed FROM silver")


def _expected(spark: SparkSession, d: str) -> DataFrame:
    return views.silver(spark, d, flags=True).select(F.col("call_id").alias("task_id"), F.array(F.lit("N"), F.lit("R")).alias("expected_call_ids"), F.col("flags").alias("call_ids"))


def _merged(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "events")
    r = e.select(F.col("event_id").alias("ordinal"), F.col("event_type").alias("field_name"), F.element_at(F.array(*map(F.lit, feedback.ACTION)), (F.col("event_id") % 3 + 1).cast("int")).alias("action"), F.element_at(F.array(*map(F.lit, feedback.TYPE)), (F.col("user_id") % 4 + 1).cast("int")).alias("field_type"), F.element_at(F.array(*map(F.lit, feedback.PRIORITY)), (F.col("user_id") % 2 + 1).cast("int")).alias("priority"), F.col("props").alias("description"), F.array(F.col("user_id").cast("string")).alias("suggested_allowed_values"))
    return feedback.merge_requests(r).select("field_name", "priority", "action", "field_type", "count", F.array_join("suggested_allowed_values", ",").alias("suggested"))


add("feedback_merge", _merged, """WITH r AS (SELECT event_type AS field_name, event_id, CAST(user_id AS VARCHAR) AS u, ['add_field', 'improve_extraction', 'add_allowed_values'][event_id % 3 + 1] AS action, ['string', 'list', 'enum', 'boolean'][user_id % 4 + 1] AS field_type, ['low', 'medium'][user_id % 2 + 1] AS priority FROM events),
    f AS (SELECT field_name, u, min(event_id) AS e, row_number() OVER (PARTITION BY field_name ORDER BY min(event_id)) AS k FROM r GROUP BY 1, 2)
    SELECT field_name, arg_max(priority, CASE priority WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END) AS priority, arg_max(action, CASE action WHEN 'add_field' THEN 3 WHEN 'improve_extraction' THEN 2 ELSE 1 END) AS action, arg_max(field_type, CASE field_type WHEN 'string' THEN 3 WHEN 'list' THEN 2 WHEN 'enum' THEN 1 ELSE 0 END) AS field_type, count(*) AS count,
    (SELECT string_agg(u, ',' ORDER BY k) FROM f WHERE f.field_name = r.field_name AND k <= 24) AS suggested FROM r GROUP BY field_name""")


def _decided(spark: SparkSession, d: str) -> DataFrame:
    c = views.table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") < 5, F.col("p_name")).alias("duplicate_of"), (F.col("p_size") > 45).alias("uncertain"), F.when(F.col("p_retailprice") > 1500, "promote").otherwise("hold").alias("status"), (F.col("p_size") % 3).alias("support"))
    return feedback.decide(c).select("p_partkey", "decision")


add("negotiation_decision", _decided, "SELECT p_partkey, CASE WHEN p_size < 5 AND p_name IS NOT NULL THEN 'merge' WHEN p_size > 45 THEN 'human_review' WHEN p_retailprice > 1500 THEN 'promote' WHEN p_size % 3 > 0 THEN 'retrieval_only' ELSE 'defer' END AS decision FROM part")

add("source_counts", lambda s, d: tasks.source_counts(views.table(s, d, "documents").withColumnRenamed("source", "source_type")), "SELECT source AS source_type, count(*) AS count FROM documents GROUP BY 1")
add("pass_rate", lambda s, d: tasks.pass_rate(_expected(s, d)), f"WITH {SILVER_SQL}, p AS (SELECT coalesce(list_has_all(flags, ['N', 'R']), false) AS passed FROM silver) SELECT count(*) AS tasks, count(*) FILTER (passed) AS passed, round(avg(CAST(passed AS DOUBLE)), 4) AS pass_rate FROM p")


def _loop(spark: SparkSession, d: str) -> DataFrame:
    p = views.table(spark, d, "part")
    run = lambda k: p.select(F.col("p_partkey").alias("task_id"), (F.col("p_size") % k == 0).alias("success"), (F.col("p_size") > 10 * k).alias("used_filter"))
    return tasks.loop_summary(run(3), run(2).where("task_id % 7 > 0"))


add("loop_summary", _loop, "WITH b AS (SELECT p_size % 3 = 0 AS s0, p_size > 30 AS f0, p_partkey % 7 > 0 AND p_size % 2 = 0 AS s1, p_partkey % 7 > 0 AND p_size > 20 AS f1 FROM part) SELECT count(*) AS tasks, count(*) FILTER (s0) AS success_before, count(*) FILTER (s1) AS success_after, count(*) FILTER (s1) - count(*) FILTER (s0) AS success_delta, count(*) FILTER (f1) - count(*) FILTER (f0) AS filter_delta FROM b")
add("records_for_chunks", lambda s, d: retrieval.records_for(chunking.pack(views.calls(s, d)).where("chunk_index % 2 = 1").select("chunk_id", F.col("chunk_index").alias("rank")), chunking.pack(views.calls(s, d)), views.calls(s, d).select("call_id")).select("call_id", "rank"), f"WITH RECURSIVE {CHUNKS_SQL} SELECT call_id, min(chunk_index) AS rank FROM chunks WHERE chunk_index % 2 = 1 GROUP BY 1")

# ---- schema on read, summaries, catalog, differences -------------------------------------------


def _aliased(spark: SparkSession, d: str) -> DataFrame:
    """Customers and orders under other names than a call's own."""
    o = views.table(spark, d, "orders")
    raw = o.select(F.col("o_orderkey").alias("ordinal"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey")).alias("call_id"), F.concat(F.lit("log-"), "o_orderkey").alias("calllog_id"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey").cast("string")).otherwise("").alias("customer_id"), F.concat(F.lit("client-"), "o_custkey").alias("client_id"), F.col("o_orderpriority").alias("company_name"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("call_date"), F.col("o_orderstatus").alias("body"))
    return calls.normalize_calls(raw).select("ordinal", "call_id", "customer_id", "account_name", "date", "transcript", F.size("turns").cast("bigint").alias("turns"), F.element_at("metadata", "source_record_id").alias("record"))


_CALL_SQL = "CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderkey AS VARCHAR) ELSE 'log-' || o_orderkey END"
add("calls_coalesce_alias", _aliased, f"SELECT o_orderkey AS ordinal, {_CALL_SQL} AS call_id, CASE WHEN o_custkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE 'client-' || o_custkey END AS customer_id, o_orderpriority AS account_name, strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderstatus AS transcript, CAST(1 AS BIGINT) AS turns, {_CALL_SQL} AS record FROM orders")
_LEX_SET_SQL = f"list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda w: length(w) >= 3 AND w NOT IN {_SEARCH_STOP}))"


def _alike(spark: SparkSession, d: str) -> DataFrame:
    """Each document with the next one of its language, by their terms."""
    docs = views.documents(spark, d)
    pairs = views.followers(docs, "lang", "call_id").select("call_id", F.col("next").alias("other_id")).where("other_id is not null")
    terms = docs.select("call_id", tx.lexical_terms("text").alias("terms"))
    both = pairs.join(terms, "call_id").join(terms.select(F.col("call_id").alias("other_id"), F.col("terms").alias("other")), "other_id")
    return both.select("call_id", "other_id", F.round(tx.jaccard(F.col("terms"), F.col("other")), 9).alias("score"))


add("jaccard_pairs", _alike, f"WITH t AS (SELECT doc_id, lang, {_LEX_SET_SQL} AS terms FROM documents), p AS (SELECT doc_id, terms, lead(doc_id) OVER w AS o, lead(terms) OVER w AS ot FROM t WINDOW w AS (PARTITION BY lang ORDER BY doc_id)) SELECT CAST(doc_id AS VARCHAR) AS call_id, CAST(o AS VARCHAR) AS other_id, round(CASE WHEN len(list_distinct(list_concat(terms, ot))) > 0 THEN CAST(len(list_intersect(terms, ot)) AS DOUBLE) / len(list_distinct(list_concat(terms, ot))) ELSE 0 END, 9) AS score FROM p WHERE o IS NOT NULL")


def _all_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*enumerate(_Q), (len(_Q), "zzqqxx unheard"), (len(_Q) + 1, "apache zzqqxx")], "query_id int, query string")


def _summary(spark: SparkSession, d: str) -> DataFrame:
    got = retrieval.search_summary(_all_queries(spark), retrieval.bm25(views.documents(spark, d), _all_queries(spark), 15))
    return got.select("query_id", F.array_join("matched_terms", " ").alias("matched"), F.array_join("missing_terms", " ").alias("missing"), F.col("chunk_count").cast("bigint").alias("chunk_count"), "failure_reason", F.array_join("top", ",").alias("top"))


_ALL_Q = (*_Q, "zzqqxx unheard", "apache zzqqxx")
_HITS_SQL = f"h AS ({_bm25_sql(_ALL_Q, 15)}), qq AS ({' UNION ALL '.join(f'SELECT CAST({i} AS INTEGER) AS query_id, {q!r} AS query' for i, q in enumerate(_ALL_Q))}), qt AS (SELECT DISTINCT query_id, unnest({tokens_sql('query')}) AS term FROM qq), hm AS (SELECT DISTINCT query_id, unnest(string_split(matched, ' ')) AS term FROM h)"
add("search_call_summary", _summary, f"WITH {_HITS_SQL} SELECT query_id, coalesce((SELECT string_agg(term, ' ' ORDER BY term) FROM hm WHERE hm.query_id = qq.query_id), '') AS matched, coalesce((SELECT string_agg(term, ' ' ORDER BY term) FROM qt WHERE qt.query_id = qq.query_id AND (query_id, term) NOT IN (SELECT (query_id, term) FROM hm)), '') AS missing, (SELECT count(*) FROM h WHERE h.query_id = qq.query_id) AS chunk_count, CASE WHEN (SELECT count(*) FROM h WHERE h.query_id = qq.query_id) = 0 THEN 'no_chunks' END AS failure_reason, coalesce((SELECT string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY rank) FROM h WHERE h.query_id = qq.query_id AND rank <= 5), '') AS top FROM qq")
add("missing_terms_except", lambda s, d: retrieval.missing_terms(_all_queries(s), retrieval.bm25(views.documents(s, d), _all_queries(s), 15)), f"WITH {_HITS_SQL} SELECT query_id, term FROM qt EXCEPT SELECT query_id, term FROM hm")
add("promotion_gate", lambda s, d: sv.quality(_extracted(s, d), views.documents(s, d)).where("status = 'promote'").select("field_name"), f"SELECT field_name FROM ({_QUALITY_SQL}) WHERE s > 0")


def _flagged(spark: SparkSession, d: str) -> DataFrame:
    """Extractions of which some are missing, some have errors and some no evidence."""
    got = _extracted(spark, d).where("ordinal % 5 > 0 or field_name <> 'level'")
    got = got.withColumn("evidence_refs", F.when(F.col("ordinal") % 4 == 0, F.array().cast("array<string>")).otherwise(F.col("evidence_refs"))).withColumn("validation_errors", F.when((F.col("ordinal") % 7 == 0) & (F.col("field_name") == "theme"), F.array(F.lit("list_item_not_string"))).otherwise(F.array().cast("array<string>")))
    return sv.pivot(views.documents(spark, d).select("call_id", "ordinal"), got, [FieldSpec("theme", "list"), FieldSpec("level", "enum")]).select("call_id", F.array_join("quality_flags", ",").alias("flags"))


add("quality_flags", _flagged, f"SELECT CAST(doc_id AS VARCHAR) AS call_id, array_to_string(list_filter([CASE WHEN doc_id % 7 = 0 THEN 'theme:list_item_not_string' END, CASE WHEN doc_id % 4 = 0 AND len({_THEME_SQL}) > 0 THEN 'theme:missing_evidence' END, CASE WHEN doc_id % 5 = 0 THEN 'level:missing_extraction' WHEN doc_id % 4 = 0 AND {_LEVEL_SQL} <> 'not_mentioned' THEN 'level:missing_evidence' END], lambda x: x IS NOT NULL), ',') AS flags FROM documents")
add("evidence_whitelist", lambda s, d: sv.whitelisted(_extracted(s, d).select(F.col("call_id"), F.explode("evidence_refs").alias("ref")).withColumn("ref", F.when(F.col("call_id").cast("bigint") % 3 == 0, F.concat("ref", F.lit("x"))).otherwise(F.col("ref"))), views.documents(s, d)).groupBy("call_id").agg(F.count_if("known").alias("kept"), F.count_if(~F.col("known")).alias("refused")), f"SELECT CAST(doc_id AS VARCHAR) AS call_id, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE n END AS kept, CASE WHEN doc_id % 3 = 0 THEN n ELSE 0 END AS refused FROM (SELECT doc_id, CAST(least(len({_THEME_SQL}), 1) + CAST({_LEVEL_SQL} <> 'not_mentioned' AS INTEGER) + CAST({_SECRET_SQL} AS INTEGER) AS BIGINT) AS n FROM documents) WHERE n > 0")
_SPECS = (FieldSpec("theme", "list", "Themes", tuple(_RULES)), FieldSpec("level", "enum", "Level", ("not_mentioned", "medium", "high")), FieldSpec("secret", "boolean", "Secret", facetable=False))
add("catalog_fields", lambda s, d: sv.catalog_table(s, list(_SPECS), sv.quality(_extracted(s, d), views.documents(s, d))).select("field_name", F.col("field_ordinal").cast("bigint").alias("field_ordinal"), "type", "path", "facetable", F.array_join("allowed_values", ",").alias("allowed"), "support_call_count", "status"), f"SELECT field_name, field_ordinal, type, 'silver_calls.' || field_name AS path, facetable, allowed, CAST(s AS BIGINT) AS support_call_count, CASE WHEN s > 0 THEN 'promote' ELSE 'hold' END AS status FROM (VALUES ('theme', CAST(0 AS BIGINT), 'list', true, '{','.join(_RULES)}'), ('level', 1, 'enum', true, 'not_mentioned,medium,high'), ('secret', 2, 'boolean', false, '')) v(field_name, field_ordinal, type, facetable, allowed) JOIN ({_QUALITY_SQL}) USING (field_name)")
add("schema_delta_except", lambda s, d: feedback.schema_delta(*[views.table(s, d, "part").where(w).select(F.concat("p_name", F.lit("_"), F.col("p_size").cast("string")).alias("field_name")) for w in ("p_size <= 25", "p_size % 2 = 0")]), "WITH p AS (SELECT p_name || '_' || p_size AS field_name, p_size FROM part) SELECT 'added' AS change, field_name FROM (SELECT field_name FROM p WHERE p_size % 2 = 0 EXCEPT SELECT field_name FROM p WHERE p_size <= 25) UNION ALL SELECT 'removed', field_name FROM (SELECT field_name FROM p WHERE p_size <= 25 EXCEPT SELECT field_name FROM p WHERE p_size % 2 = 0)")
add("value_counts", lambda s, d: feedback.value_counts(views.silver(s, d, flags=True), "flags"), f"WITH {SILVER_SQL} SELECT key, count(*) AS count FROM (SELECT unnest(flags) AS key FROM silver) GROUP BY 1")
add("usage_deltas", lambda s, d: feedback.usage_deltas(views.table(s, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("ordinal"), (F.col("event_id") % 1000).alias("input_tokens"), (F.col("user_id") % 100).alias("output_tokens"))).select("run_id", "ordinal", "input_delta", "output_delta"), "SELECT user_id AS run_id, event_id AS ordinal, event_id % 1000 - coalesce(lag(event_id % 1000) OVER w, 0) AS input_delta, user_id % 100 - coalesce(lag(user_id % 100) OVER w, 0) AS output_delta FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
add("last_entries", lambda s, d: feedback.last_entries(views.table(s, d, "events").select("user_id", "event_id"), "user_id", "event_id", 6), "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 6")
add("failures_by_reason", lambda s, d: feedback.distinct_failures(views.table(s, d, "events").select(F.col("event_id").alias("ordinal"), F.when(F.col("user_id") % 5 > 0, F.concat("event_type", F.lit(" "), F.col("user_id") % 5)).otherwise(" ").alias("reason"))).select("reason", "ordinal"), "SELECT event_type || ' ' || (user_id % 5) AS reason, min(event_id) AS ordinal FROM events WHERE user_id % 5 > 0 GROUP BY 1")
add("field_candidates", lambda s, d: negotiation.candidates(_reports(s, d), _wishes(s, d)).select("field_name", "source", "support", "uncertain", "decision"), "WITH r AS (SELECT p_name AS field_name, max(p_size) % 7 AS s FROM part WHERE p_size > 10 GROUP BY 1), w AS (SELECT p_name AS field_name, count(*) AS n FROM part WHERE p_size % 3 = 0 GROUP BY 1) SELECT field_name, CASE WHEN r.s IS NULL THEN 'feedback' WHEN n IS NULL THEN 'schema' ELSE 'schema+feedback' END AS source, CAST(coalesce(r.s, 0) AS BIGINT) AS support, r.s IS NULL OR r.s = 0 AS uncertain, CASE WHEN r.s IS NULL OR r.s = 0 THEN 'human_review' WHEN r.s >= 3 THEN 'promote' ELSE 'retrieval_only' END AS decision FROM r FULL JOIN w USING (field_name)")
add("candidate_tasks", lambda s, d: negotiation.matching_tasks(views.table(s, d, "benchmark").select(F.col("item_id").cast("string").alias("field_name"), tx.query_terms("text").alias("terms")), views.table(s, d, "documents").select(F.col("doc_id").alias("ordinal"), F.col("text").alias("query"))).select("field_name", F.array_join(F.transform("tasks", lambda x: x.cast("string")), ",").alias("tasks")), f"WITH c AS (SELECT CAST(item_id AS VARCHAR) AS field_name, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN {_QUERY_STOP})) AS term FROM benchmark), d AS (SELECT doc_id, lower(text) AS low FROM documents), m AS (SELECT DISTINCT doc_id, term FROM (SELECT DISTINCT term FROM c) JOIN d ON contains(low, term)), h AS (SELECT DISTINCT field_name, doc_id FROM c JOIN m USING (term)), k AS (SELECT *, row_number() OVER (PARTITION BY field_name ORDER BY doc_id) AS k FROM h) SELECT field_name, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS tasks FROM k WHERE k <= 6 GROUP BY 1")


def _reports(spark: SparkSession, d: str) -> DataFrame:
    p = views.table(spark, d, "part").where("p_size > 10").groupBy(F.col("p_name").alias("field_name")).agg((F.max("p_size") % 7).cast("bigint").alias("support_call_count"))
    return p.withColumn("status", F.when(F.col("support_call_count") >= 3, "promote").otherwise("hold"))


def _wishes(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "part").where("p_size % 3 = 0").groupBy(F.col("p_name").alias("field_name")).agg(F.count(F.lit(1)).alias("count"))


# ---- questions answered end to end: control flow, so rows only ---------------------------------


def _corpus(spark: SparkSession, d: str) -> agent.Corpus:
    """Conversations packed, their built-in and inferred-like fields extracted and pivoted."""
    made = views.calls(spark, d).withColumn("transcript", F.array_join(F.transform("turns", lambda t: t["text"]), "\n")).withColumn("account_name", F.concat(F.lit("account "), "call_id"))
    chunks = chunking.pack(made)
    specs = [FieldSpec("topic", "list", "Words of a call", ("the", "and", "with")), FieldSpec("urgency", "enum", allowed_values=("not_mentioned", "medium", "high")), FieldSpec("next_action", "string", aggregatable=False)]
    got = sv.extract(made, chunks, sv.rows_for(specs))
    return agent.Corpus(sv.pivot(made, got, specs), chunks, Catalog.of(*specs))


def _answer(spark: SparkSession, d: str, plan: planner.Plan) -> DataFrame:
    class Given:
        def plan(self, query: str, catalog: Catalog) -> planner.Plan:
            return plan

    got = agent.Agent(_corpus(spark, d), Given()).answer(plan.query)
    rows = [("record", str(r["call_id"]), 0) for r in got["records"]] + [("group", str(k), int(n)) for k, n in got["aggregation"].items()] + [("evidence", str(e["chunk_id"]), 0) for e in got["evidence"]]
    return spark.createDataFrame([*rows, ("success", str(got["judgement"]["success"]), 0)], "kind string, value string, count int")


def _planned(operation: str, **more) -> planner.Plan:
    p = planner.Plan(operation, query="the call with the need", **more)
    return replace(p, steps=planner.default_steps(p))


add("agent_answer_filter", lambda s, d: _answer(s, d, _planned("filter", filters={"topic": "the"})))
add("agent_answer_aggregate", lambda s, d: _answer(s, d, _planned("aggregate", group_by="topic")))
add("agent_answer_search", lambda s, d: _answer(s, d, _planned("search")))


def _demo(spark: SparkSession, d: str) -> DataFrame:
    """Questions before and after a schema takes up what the judge asked for."""
    return loop.run(_corpus(spark, d), ["calls with the and that", "how many calls by topic"]).select("phase", "task_id", "success", "used_filter")


add("loop_demo", _demo)

# ---- small text rules, scripts without spaces --------------------------------------------------

_text("normalized_query", lambda: tx.normalized_query("text"), f"array_to_string({tokens_sql('text')}, ' ')")
_WORDS_SQL = r"list_transform(regexp_split_to_array(regexp_replace(lower(text), '[-/]', ' ', 'g'), '\s+'), lambda w: regexp_replace(w, '[^\p{L}\p{N}_]', '', 'g'))"
add("suggested_values", lambda s, d: views.documents(s, d).select("chunk_id", F.array_join(tx.suggested_values("text"), " ").alias("value")), f"WITH w AS (SELECT doc_id, {_WORDS_SQL} AS ws FROM documents), u AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM w), f AS (SELECT doc_id, w, min(p) AS p FROM u WHERE length(w) >= 3 AND w NOT IN {_QUERY_STOP} GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS k FROM f) SELECT documents.doc_id AS chunk_id, coalesce(string_agg(w, ' ' ORDER BY p), '') AS value FROM documents LEFT JOIN (SELECT * FROM k WHERE k <= 8) k ON k.doc_id = documents.doc_id GROUP BY 1")
add("first_text", lambda s, d: views.table(s, d, "events").select("event_id", tx.first_text(F.when(F.col("event_id") % 3 == 0, F.lit("  ")).when(F.col("event_id") % 3 == 1, F.concat(F.lit(" a  "), "event_type")), "props").alias("text"), tx.choice(F.concat(F.lit(" "), F.upper("event_type")), ("click", "view"), "other").alias("choice")), "SELECT event_id, CASE WHEN event_id % 3 = 1 THEN 'a ' || event_type ELSE props END AS text, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'other' END AS choice FROM events")
_KANA = ("aeiou", "あえいおう")
_UNSPACED_SQL = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}ー々]"
_CUT_SQL = f"CASE WHEN NOT regexp_matches(t, '^{_UNSPACED_SQL}') THEN [regexp_replace(t, '''s$', '')] WHEN length(t) < 2 THEN [t] ELSE list_transform(range(1, length(t)), lambda i: t[i:i + 1]) END"
add(
    "script_tokens",
    lambda s, d: views.documents(s, d).select("chunk_id", F.array_join(tx.script_tokens(F.translate(F.lower("text"), *_KANA)), " ").alias("value")),
    f"SELECT doc_id AS chunk_id, array_to_string(list_filter(flatten(list_transform(regexp_extract_all(replace(translate(lower(text), '{_KANA[0]}', '{_KANA[1]}'), '_', ' '), '{_UNSPACED_SQL}+|[a-z0-9]+(?:''[a-z]+)?'), lambda t: {_CUT_SQL})), lambda t: regexp_matches(t, '^{_UNSPACED_SQL}') OR (length(t) >= 2 AND t NOT IN {views.STOP_SQL})), ' ') AS value FROM documents",
)

# ---- several queries by vectors, typed JSON, table functions -----------------------------------


def _three(spark: SparkSession, d: str) -> list[tuple[int, list[float]]]:
    return [(r["vec_id"], list(r["embedding"])) for r in views.table(spark, d, "embeddings").where("vec_id < 3").collect()]


_BATCH_SQL = "SELECT CAST(query_id AS INTEGER) AS query_id, chunk_id, round(c, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, chunk_id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS c FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id < 3) q)) WHERE rank <= 10"
add("cosine_batch_fanout", lambda s, d: retrieval.embedding_batch(_vectors(s, d), _three(s, d), 10).select("query_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank")), _BATCH_SQL)
add("hybrid_batch_fanout", lambda s, d: retrieval.zipped(retrieval.bm25(views.documents(s, d), _queries(s), 10), retrieval.embedding_batch(_vectors(s, d), _three(s, d), 10), 12).select("query_id", "chunk_id", F.col("rank").cast("bigint").alias("rank")), f"WITH a AS ({_bm25_sql(_Q, 10)}), b AS ({_BATCH_SQL}), u AS (SELECT query_id, chunk_id, rank * 2 AS place FROM a UNION ALL SELECT query_id, chunk_id, rank * 2 + 1 FROM b), m AS (SELECT query_id, chunk_id, min(place) AS place FROM u GROUP BY 1, 2) SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank FROM m) WHERE rank <= 12")


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    """The events' property as a number, as text, as a list, as null, left out, in what is no JSON, or as a flag."""
    k = F.get_json_object("props", "$.k")
    forms = [F.concat(F.lit('{"k": '), k, F.lit("}")), F.concat(F.lit('{"k": "'), k, F.lit('"}')), F.concat(F.lit('{"k": ['), k, F.lit("]}")), F.lit('{"k": null}'), F.lit("{}"), F.concat(F.lit("{k"), k), F.lit('{"k": true}')]
    rows = views.table(spark, d, "events").select("event_id", variants.parsed(F.element_at(F.array(*forms), (F.col("event_id") % 7 + 1).cast("int"))).alias("v"))
    return variants.silver_rows(rows, "v", {"k": "$.k"}, ("event_id",))


add("variant_fields", lambda s, d: _mixed(s, d).select("event_id", "k.kind", "k.number", "k.string", "k.flag", "k.json", variants.compared("k", ">=", 50).alias("high")), """WITH e AS (SELECT event_id, event_id % 7 AS f, json_extract_string(props, '$.k') AS k FROM events)
    SELECT event_id, ['number', 'string', 'array', 'null', 'missing', 'missing', 'boolean'][f + 1] AS kind, CASE WHEN f = 0 THEN CAST(k AS DOUBLE) END AS number, CASE WHEN f = 1 THEN k END AS string, CASE WHEN f = 6 THEN true END AS flag, CASE WHEN f = 2 THEN '[' || k || ']' END AS json, f = 0 AND CAST(k AS DOUBLE) >= 50 AS high FROM e""")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    tables.register_all(spark)
    return spark.sql("SELECT chunk_id, speakers, text FROM pack_turns(TABLE({turns}))", turns=views.turns(spark, d).select("call_id", "turn_index", "speaker", "text"))


add("chunk_rows_udtf", _packed, SQL["chunk_rows"])

# ---- runs in batches, traces -------------------------------------------------------------------


def _batched(spark: SparkSession, d: str) -> DataFrame:
    """The themes of ``keyword_extract_list`` in four batches; the run is stopped after the second and taken up again."""
    docs = views.documents(spark, d)
    size = -(-docs.count() // 4)

    def work(calls: DataFrame) -> DataFrame:
        own = calls.select("call_id", "ordinal", F.col("text").alias("transcript"), F.array(F.struct(F.lit(1).alias("turn_index"), F.lit("u").alias("speaker"), "text")).alias("turns"))
        chunks = calls.select("call_id", F.lit(1).alias("chunk_index"), F.col("call_id").alias("chunk_id"), "text")
        return sv.extract(own, chunks, [sv.list_row("theme", 0, _RULES)]).select("call_id", F.array_join("value_list", ",").alias("themes"), F.size("evidence_refs").cast("bigint").alias("refs"))

    run = Batches(spark, f"{shared_folder(spark)}/themes-{state_of(docs)}", docs, work, size, {"found": F.count_if(F.col("refs") > 0)}, lambda batch, total: "half" if batch["batch"] == 1 else None)
    while run.run()["stopped"]:
        pass
    return run.result().select("call_id", "themes", "refs")


add("extract_in_batches", _batched, SQL["keyword_extract_list"])


def _traced(spark: SparkSession, d: str) -> DataFrame:
    """Figures of two steps over the events, as the jobs that ran them observed."""
    e = views.table(spark, d, "events")
    asked = e.select((F.col("event_id") % 1000).alias("input_tokens"), (F.col("user_id") % 100).alias("output_tokens"), F.when(F.col("event_type") == "error", F.lit("failed")).alias("error"))
    tracer = Tracer((2.0, 8.0))
    for name, frame in (("all", asked), ("failed", asked.where("error is not null"))):
        tracer.step(name, frame, lambda f: f.write.format("noop").mode("overwrite").save())
    return tracer.table(spark).select("step", "name", "rows", "input_tokens", "output_tokens", "errors", "cost_usd")


add("trace_figures", _traced, "WITH a AS (SELECT event_id % 1000 AS i, user_id % 100 AS o, event_type = 'error' AS bad FROM events), f AS (SELECT 1 AS step, 'all' AS name, * FROM a UNION ALL SELECT 2, 'failed', * FROM a WHERE bad) SELECT step, name, count(*) AS rows, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, count(*) FILTER (bad) AS errors, round((2 * sum(i) + 8 * sum(o)) / 1000000.0, 10) AS cost_usd FROM f GROUP BY 1, 2")
