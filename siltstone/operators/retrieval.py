"""Top-k retrieval over chunks: lexical overlap, BM25, cosine, hybrid; one query or a batch in one job.

Corpus statistics always come from the whole corpus; a filter restricts candidates afterwards. Terms
of the queries are few: postings are cut to them while the texts are scanned, so only
matching postings are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import cosine, english_tokens, lexical_terms

K1, B = 1.2, 0.75
#: Subqueries that one search may fan out to.
MAX_FANOUT = 20


def bounded_limit(value, default: int = 10) -> int:
    try:
        return max(1, min(100, int(value)))
    except (TypeError, ValueError):
        return default


def search_documents(chunks: DataFrame, silver: DataFrame | None = None, fields: tuple[str, ...] = ()) -> DataFrame:
    """(chunk_id, call_id, bm25_text, embedding_text): the chunk twice, then field values and account."""
    if silver is None:
        return chunks.select("chunk_id", "call_id", F.concat_ws("\n", "text", "text").alias("bm25_text"), F.col("text").alias("embedding_text"))
    kinds = dict(silver.dtypes)
    values = [F.when(F.col(f), "True") if kinds[f] == "boolean" else F.array_join(f, " ") if kinds[f].startswith("array") else F.nullif(F.nullif(F.col(f).cast("string"), F.lit("not_mentioned")), F.lit("")) for f in fields]
    told = silver.select("call_id", "account_name", F.translate(F.concat_ws(" ", *values), "_", " ").alias("field_text"))
    both = chunks.join(told, "call_id", "left")
    return both.select("chunk_id", "call_id", F.concat_ws("\n", "text", "text", F.nullif("field_text", F.lit("")), "account_name").alias("bm25_text"), F.concat_ws("\n", F.concat(F.lit("Account: "), F.coalesce("account_name", F.lit("unknown"))), F.concat(F.lit("Signals: "), F.coalesce("field_text", F.lit(""))), "text").alias("embedding_text"))


def corpus_stats(docs: DataFrame, text: str = "bm25_text") -> DataFrame:
    """(n, avgdl) over all documents, empty ones too."""
    return docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(F.size(english_tokens(text)), F.lit(0))).alias("avgdl"))


def query_term_lists(queries: DataFrame, terms: Column) -> list[tuple[Any, list[str]]]:
    """(query_id, sorted distinct terms) of the queries, which a fan-out bounds."""
    rows = queries.select("query_id", F.array_sort(F.array_distinct(terms)).alias("terms")).limit(MAX_FANOUT + 1).collect()
    if len(rows) > MAX_FANOUT:
        raise ValueError(f"at most {MAX_FANOUT} queries")
    return [(r["query_id"], r["terms"] or []) for r in rows]


def bm25(docs: DataFrame, queries: DataFrame, limit: int | None = 10, allowed: DataFrame | None = None, id_col: str = "chunk_id", text: str = "bm25_text", tokens: Callable[[str | Column], Column] = english_tokens) -> DataFrame:
    """queries (query_id, query; at most MAX_FANOUT) -> (query_id, id, score, matched_terms, rank), scores > 0 only. ``tokens`` cuts
    texts and queries alike.

    Each term's contribution is rounded to six places, then summed; ranked by that sum and the id. A document is one row with the tokens that
    any query asks for, so all queries are scored where it is read: only the statistics (one row) and the best hits move."""
    asked = query_term_lists(queries, tokens("query"))
    terms = sorted({t for _, ts in asked for t in ts})
    told = docs.select(id_col, tokens(text).alias("tokens")).select(id_col, F.coalesce(F.size("tokens"), F.lit(0)).alias("dl"), F.filter("tokens", lambda t: t.isin(*terms)).alias("said"))
    df_of = [F.count_if(F.array_contains("said", t)) for t in terms]
    stats = told.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), F.array(*df_of).cast("array<bigint>").alias("df"))
    # no filter on what is said: it would be pushed below, and tokens be taken twice
    hits = (told if allowed is None else told.join(allowed, id_col, "left_semi")).crossJoin(F.broadcast(stats))

    def part(t: str) -> Column:
        df, tf = F.get("df", F.lit(terms.index(t))), F.size(F.filter("said", lambda x: x == t))
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        return F.round(idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.greatest("avgdl", F.lit(1.0)))), 6)

    def scored(query_id: Any, own: list[str]) -> Column:
        parts = F.filter(F.array(*[F.struct(F.lit(t).alias("term"), part(t).alias("part")) for t in own]), lambda x: F.array_contains("said", x["term"]))
        return F.struct(F.lit(query_id).alias("query_id"), F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x["part"]).alias("raw"), F.transform(parts, lambda x: x["term"]).alias("matched_terms"))

    per = F.array(*[scored(i, ts) for i, ts in asked if ts])
    if not terms:
        per = F.array().cast(f"array<struct<query_id:{queries.schema['query_id'].dataType.simpleString()},raw:double,matched_terms:array<string>>>")
    each = hits.select(id_col, F.explode(F.when(F.size("said") > 0, F.filter(per, lambda x: x["raw"] > 0))).alias("x")).select("x.query_id", id_col, "x.raw", "x.matched_terms")
    return ranked(each, limit, id_col)


def ranked(scored: DataFrame, limit: int | None, id_col: str = "chunk_id") -> DataFrame:
    """Rank within each query by (-raw, id); scores are rounded after ranking."""
    w = Window.partitionBy("query_id").orderBy(F.desc("raw"), id_col)
    out = scored.withColumn("rank", F.row_number().over(w))
    if limit is not None:
        out = out.where(F.col("rank") <= limit)
    return out.withColumn("score", F.round("raw", 6)).drop("raw")


def explain(docs: DataFrame, queries: DataFrame, hits: DataFrame, id_col: str = "chunk_id", text: str = "bm25_text") -> DataFrame:
    """Per hit and query term: (query_id, id, term, tf, df, idf, contribution); tf 0 where the term is missing."""
    q = queries.select("query_id", F.posexplode(F.array_distinct(english_tokens("query"))).alias("term_pos", "term"))
    stats = corpus_stats(docs, text)
    tokens = docs.select(id_col, english_tokens(text).alias("tokens"))
    df = tokens.select(id_col, F.explode(F.array_distinct("tokens")).alias("term")).join(q.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    base = hits.select("query_id", id_col).join(q, "query_id").join(tokens, id_col).join(df, "term", "left").crossJoin(F.broadcast(stats))
    tf = F.size(F.filter("tokens", lambda t: t == F.col("term")))
    d = F.coalesce("df", F.lit(0))
    idf = F.log(1 + (F.col("n") - d + 0.5) / (d + 0.5))
    part = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.size("tokens") / F.greatest("avgdl", F.lit(1.0))))
    return base.select("query_id", id_col, "term_pos", "term", tf.alias("tf"), d.alias("df"), F.round(idf, 6).alias("idf"), F.round(part, 6).alias("contribution"))


def lexical_score(text: str, terms: list[str]) -> Column:
    """How many of the terms are substrings of the lower-cased text."""
    low = F.lower(F.col(text))
    out = F.lit(0)
    for t in terms:
        out = out + F.coalesce(low.contains(t), F.lit(False)).cast("int")
    return out


def lexical(docs: DataFrame, queries: DataFrame, limit: int | None = 5, id_col: str = "chunk_id", text: str = "text", terms: Column | None = None) -> DataFrame:
    """Batch of queries by the number of distinct terms found as substrings. The queries' terms are bound as literals
    of one scan (at most MAX_FANOUT queries), so no pair of query and document without a hit leaves the scan. ``terms``: how a query's terms are
    taken, if not as ``lexical_terms`` (ingest searches without a stop list: ``lexical_terms("query", ())``)."""
    asked = query_term_lists(queries, lexical_terms("query") if terms is None else terms)
    per = F.array(*[F.struct(F.lit(i).alias("query_id"), lexical_score(text, ts).alias("raw")) for i, ts in asked])
    each = docs.select(id_col, F.explode(F.filter(per, lambda x: x["raw"] > 0)).alias("x")).select("x.query_id", id_col, F.col("x.raw").cast("double").alias("raw"))
    return ranked(each, limit, id_col)


def embedding(docs: DataFrame, vector: list[float], limit: int = 10, allowed: DataFrame | None = None, id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """Cosine of one query vector with every candidate, no cut at zero; (id, score, rank)."""
    out = docs if allowed is None else docs.join(allowed, id_col, "left_semi")
    scored = out.select(id_col, cosine(vector_col, F.array(*[F.lit(float(v)) for v in vector])).alias("raw")).orderBy(F.desc("raw"), id_col).limit(limit)
    return ranked(scored.withColumn("query_id", F.lit(0)), None, id_col).drop("query_id")


def embedding_batch(docs: DataFrame, vectors: list[tuple[Any, list[float]]], limit: int | None = 10, allowed: DataFrame | None = None, id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """Cosine of several queries' vectors [(query_id, vector)] with every candidate, in one scan: (query_id, id, rank, score). The queries are one broadcast row."""
    if len(vectors) > MAX_FANOUT:
        raise ValueError(f"at most {MAX_FANOUT} queries")
    one = docs.sparkSession.createDataFrame([([(i, [float(x) for x in v]) for i, v in vectors],)], "_asked array<struct<query_id:int,vector:array<double>>>")
    out = docs if allowed is None else docs.join(allowed, id_col, "left_semi")
    each = out.select(id_col, vector_col).crossJoin(F.broadcast(one)).select(id_col, vector_col, F.explode("_asked").alias("q"))
    return ranked(each.select("q.query_id", id_col, cosine(vector_col, F.col("q.vector")).alias("raw")), limit, id_col)


def zipped(first: DataFrame, second: DataFrame, limit: int, id_col: str = "chunk_id") -> DataFrame:
    """Per query, two ranked lists interleaved by rank, the first list ahead, each id once: (query_id, id, rank)."""
    both = first.select("query_id", id_col, "rank", F.lit(0).alias("src")).unionByName(second.select("query_id", id_col, "rank", F.lit(1).alias("src")))
    best = both.groupBy("query_id", id_col).agg(F.min(F.struct("rank", "src")).alias("at"))
    return best.select("query_id", id_col, F.row_number().over(Window.partitionBy("query_id").orderBy("at")).alias("rank")).where(F.col("rank") <= limit)


def zipper(first: DataFrame, second: DataFrame, limit: int, id_col: str = "chunk_id") -> DataFrame:
    """Two ranked lists interleaved by rank, the first list ahead; each id once: (id, position)."""
    both = first.select(id_col, "rank", F.lit(0).alias("src")).unionByName(second.select(id_col, "rank", F.lit(1).alias("src")))
    best = both.groupBy(id_col).agg(F.min(F.struct("rank", "src")).alias("at")).orderBy("at").limit(limit)
    return best.withColumn("position", F.row_number().over(Window.orderBy("at"))).drop("at")


def fetch(chunks: DataFrame, refs: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """refs (pos, ref) -> the chunks they name, in order, repeats kept, unknown ones dropped."""
    want = refs.select("pos", F.regexp_replace("ref", "^chunk:", "").alias(id_col))
    return want.join(chunks, id_col).orderBy("pos")


def records_for(hits: DataFrame, chunks: DataFrame, silver: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Distinct silver rows behind ranked hits, by first hit."""
    first = hits.join(chunks.select(id_col, "call_id"), id_col).groupBy("call_id").agg(F.min("rank").alias("rank"))
    return first.join(silver, "call_id").orderBy("rank")


def missing_terms(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, term) of the query terms that no hit matched."""
    asked = queries.select("query_id", F.explode(F.array_distinct(english_tokens("query"))).alias("term"))
    return asked.exceptAll(asked.join(hits.select("query_id", F.explode("matched_terms").alias("term")).distinct(), ["query_id", "term"], "left_semi"))


def search_summary(queries: DataFrame, hits: DataFrame, most: int = 5, id_col: str = "chunk_id") -> DataFrame:
    """(query_id, query, query_terms, matched_terms, missing_terms, chunk_count, failure_reason, top): one row per search call. It failed if it found
    no chunk, or chunks that match none of its terms."""
    none = F.array().cast("array<string>")
    by_query = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("chunk_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("rank") <= 100, F.col("matched_terms")))))).alias("matched_terms"), F.array_sort(F.collect_list(F.when(F.col("rank") <= most, F.struct("rank", F.col(id_col).cast("string").alias("id"))))).alias("best"))
    out = queries.select("query_id", "query", F.array_sort(F.array_distinct(english_tokens("query"))).alias("query_terms")).join(by_query, "query_id", "left")
    matched = F.coalesce("matched_terms", none)
    n = F.coalesce("chunk_count", F.lit(0))
    why = F.when(n == 0, "no_chunks").when((F.size(matched) == 0) & (F.size("query_terms") > 0), "no_lexical_match")
    return out.select("query_id", "query", "query_terms", matched.alias("matched_terms"), F.array_except("query_terms", matched).alias("missing_terms"), n.alias("chunk_count"), why.alias("failure_reason"), F.coalesce(F.transform("best", lambda x: x["id"]), none).alias("top"))


def unknown_chunks(hits: DataFrame, chunks: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Ids among a branch's hits that aren't chunks of the corpus: a branch whose list isn't empty is refused."""
    return hits.select(id_col).distinct().join(chunks.select(id_col), id_col, "left_anti")


def diverse(queries: list[str], most: int = MAX_FANOUT, alike: float = 0.8) -> list[str]:
    """Subqueries without those that say what an earlier one says (Jaccard of tokens above ``alike``). Driver only: a few strings."""
    import re

    from siltstone.functions.text import ENGLISH_STOPWORDS, TOKEN

    kept: list[tuple[str, frozenset[str]]] = []
    for q in queries:
        found = [re.sub("'s$", "", t) for t in re.findall(TOKEN, q.lower().replace("_", " "))]
        terms = frozenset(t for t in found if len(t) > 1 and t not in ENGLISH_STOPWORDS)
        if q.strip() and not any(terms == k or terms | k and len(terms & k) / len(terms | k) > alike for _, k in kept):
            kept.append((q, terms))
        if len(kept) == most:
            break
    return [q for q, _ in kept]
