"""One query per operator of this subpackage, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, embed_dedup, fingerprint, mixing, ngram_join, pii, secret_scan, token_counts, toxicity, url_filter, vector_codes, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_join.jaccard_components(_table(spark, sf_dir, "documents"), n=3, percent=90)
    return out.select("doc_id", "n_shingles", "component_id", "n_links")


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), with_ids=False)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = warc.write(_table(spark, sf_dir, "pages"), warc.new_root(spark))
    out = warc.read(spark, root)
    return out.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", "probability", "weight", "selected")


def op7_e8_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"), least=0.95)


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    # whoever runs this on data of their own sets the key; the one given here is no secret
    key = spark.conf.get("siltstone.pii.key", "key of the registered query")
    return pii.pseudonymise(_table(spark, sf_dir, "documents"), key).select("doc_id", "text", "n_entities")


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edited(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted")


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings"), k=8, rounds=10, dim=64, scale=1024, seed="3")


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(_table(spark, sf_dir, "documents"), limit=4096)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vector_codes.compress(_table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


#: floor(sum / count) of whole numbers; the division of SQL goes towards zero.
_FLOOR = "((s - ((s % n) + n) % n) // n)"
_GOOD = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _centroids_sql(k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024) -> str:
    """Each round is a pair of tables: assignments, each the least (distance, number), and the centroids they make."""
    sql = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE {_GOOD} AND len(embedding) = {dim})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, q FROM v QUALIFY c < {k})",
    ]
    for r in range(rounds + 1):
        sql.append(f"a{r} AS MATERIALIZED (SELECT vec_id, v.q AS q, min([list_sum(list_transform(list_zip(v.q, c{r}.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c]) AS m FROM v, c{r} GROUP BY vec_id, v.q)")
        if r < rounds:
            sql.append(f"s{r} AS (SELECT m[2] AS c, p, sum(x) AS s, count(*) AS n FROM (SELECT m, unnest(q) AS x, generate_subscripts(q, 1) AS p FROM a{r}) GROUP BY 1, 2)")
            sql.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.c AS c, coalesce(f, q) AS q FROM c{r} LEFT JOIN (SELECT c, list(CAST({_FLOOR} AS BIGINT) ORDER BY p) AS f FROM s{r} GROUP BY c) USING (c))")
    return "WITH " + ", ".join(sql) + f"""
        SELECT vec_id, CAST(m[2] AS INTEGER) AS cluster, CAST(m[1] AS BIGINT) AS distance, CAST(sum(m[1]) OVER (PARTITION BY m[2]) AS BIGINT) AS cluster_inertia,
               CAST(sum(m[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.q, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} ON c = m[2]"""


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, dim: int = 64, scale: int = 4096) -> str:
    """As above, with a codebook for each part position."""
    size = dim // parts
    sql = [
        f"w AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE {_GOOD})",
        f"v AS MATERIALIZED (SELECT vec_id, part, q[part * {size} + 1 : part * {size} + {size}] AS q FROM w, (SELECT unnest(range({parts})) AS part))",
        f"c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS c, q FROM v QUALIFY c < {entries})",
    ]
    for r in range(rounds + 1):
        sql.append(f"a{r} AS MATERIALIZED (SELECT vec_id, part, v.q AS q, min([list_sum(list_transform(list_zip(v.q, c{r}.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c]) AS m FROM v JOIN c{r} USING (part) GROUP BY vec_id, part, v.q)")
        if r < rounds:
            sql.append(f"s{r} AS (SELECT part, m[2] AS c, p, sum(x) AS s, count(*) AS n FROM (SELECT part, m, unnest(q) AS x, generate_subscripts(q, 1) AS p FROM a{r}) GROUP BY 1, 2, 3)")
            sql.append(f"c{r + 1} AS MATERIALIZED (SELECT part, c{r}.c AS c, coalesce(f, q) AS q FROM c{r} LEFT JOIN (SELECT part, c, list(CAST({_FLOOR} AS BIGINT) ORDER BY p) AS f FROM s{r} GROUP BY part, c) USING (part, c))")
    sql.append(f"e AS MATERIALIZED (SELECT vec_id, string_agg(printf('%02x', m[2]), '' ORDER BY part) AS code, CAST(sum(m[1]) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)")
    return "WITH " + ", ".join(sql) + f"""
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
               (SELECT sha256(string_agg(array_to_string(q, ','), ',' ORDER BY part, c)) FROM c{rounds}) AS codebooks_sha256
        FROM w JOIN e USING (vec_id)"""


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_bpe_codec, op3_url_filter, op4_secret_scan, op5_warc, op6_mixture, op7_e8_dedup, op8_pii_surrogates, op9_fingerprint, op10_toxicity, op11_centroid_clusters, op12_token_counts, op13_vector_codes)}
SQL = {
    "op1_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                  ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        e AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM e JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
        r AS (SELECT a AS id, b AS other FROM l UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.other),
        c AS (SELECT id, min(other) AS least_id FROM r GROUP BY 1),
        d AS (SELECT a, count(*) AS n_links FROM l GROUP BY 1)
        SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(least_id, w.doc_id)) AS component_id, coalesce(n_links, 0) AS n_links
        FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.id = w.doc_id LEFT JOIN d ON d.a = w.doc_id""",
    "op7_e8_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda q: q IS NULL OR NOT isfinite(q))) = 0 AND len(list_filter(embedding, lambda q: q <> 0)) > 0),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
        r AS (SELECT a AS id, b AS other FROM l UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.other),
        c AS (SELECT id, min(other) AS least_id FROM r GROUP BY 1),
        d AS (SELECT a, count(*) AS n_links FROM l GROUP BY 1)
        SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(least_id, vec_id)) AS component_id, vec_id <= coalesce(least_id, vec_id) AS kept
        FROM embeddings LEFT JOIN c ON c.id = vec_id LEFT JOIN d ON d.a = vec_id""",
    "op5_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM f""",
    "op11_centroid_clusters": _centroids_sql(),
    "op13_vector_codes": _codes_sql(),
}
