"""A content-addressed web archive.

Two tables in one folder: ``payloads`` holds every distinct payload once under
its SHA-256, ``headers`` the exact header block of every record. Records are rebuilt by joining
both on the digest. Payloads are checked on the way in (a second, independent hash must agree
among all that share a digest) and on the way out (the digest is computed anew).

Payloads are merged within each task before they are shuffled, so a page copied a
million times moves once a task; headers and addresses, which are narrow, are what is joined, and what very many
share is dealt to several tasks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_split, shared_dir

#: Payloads shorter than this aren't worth a revisit record: each is a response.
LEAST_REVISIT = 100
_CRLF = "\r\n"


def _urn(c: Column) -> Column:
    """A record id that follows from the page's id."""
    h = F.sha2(F.concat(F.lit("record:"), c.cast("string")), 256)
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-a"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))


def write(pages: DataFrame, root: str, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> str:
    """Writes a record per row into the folder ``root`` and returns it.

    Null html is an empty payload. Of rows with equal payloads of LEAST_REVISIT bytes or more that with the
    smallest id is the response; the others revisit it. Rows that repeat that id, and
    rows without an id, are responses; without an id a record's own comes from its address and payload. Line ends in urls are percent-encoded."""
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    src = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    x = F.xxhash64("payload", F.lit(91))
    store = src.groupBy("digest").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.any_value("payload").alias("payload"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    same = F.when(F.col("lo") == F.col("hi"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("two payloads share digest "), F.col("digest"))).cast("binary"))
    store.select("digest", "first_id", "copies", same.alias("payload")).write.option("compression", "zstd").parquet(f"{root}/payloads")
    firsts = pages.sparkSession.read.parquet(f"{root}/payloads").select("digest", "first_id", "copies")
    rows = join_split(src.select("id", "url", "digest", F.length("payload").cast("long").alias("bytes")), firsts.select("digest", "first_id"), "digest", firsts.select("digest", "copies"), F.xxhash64("id", "url"))
    again = (F.col("bytes") >= LEAST_REVISIT) & F.coalesce(F.col("id") != F.col("first_id"), F.lit(False))
    url = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF))
    header = F.concat(
        F.lit("WARC/1.1" + _CRLF),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.coalesce(_urn(F.col("id")), _urn(F.concat_ws("|", F.lit("no id"), "url", "digest")))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(again, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", _urn(F.col("first_id"))), line("X-Refers-To-Page", F.col("first_id").cast("string")))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(again, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit(_CRLF),
    )
    rows.select("id", "digest", header.alias("header")).write.option("compression", "zstd").parquet(f"{root}/headers")
    return root


def _field(name: str) -> Column:
    found = F.regexp_extract("header", rf"\r\n{name}: ([^\r]*)\r\n", 1)
    return F.when(found != "", found)


def read(spark: SparkSession, root: str) -> DataFrame:
    """Every record rebuilt: id, header, payload (of revisits: what they refer to), record (the bytes of the
    record as a WARC file has them), record_type, payload_digest, payload_bytes, refers_to, url.

    A payload that doesn't have its digest ends the read with an error."""
    fresh = F.sha2("payload", 256)
    good = F.when(fresh == F.col("digest"), fresh).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest"))).cast("string"))
    store = spark.read.parquet(f"{root}/payloads").select("digest", "payload", good.alias("checked"), F.length("payload").cast("long").alias("payload_bytes"))
    headers = spark.read.parquet(f"{root}/headers")
    counts = headers.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"))
    out = join_split(headers, store, "digest", counts, F.xxhash64("header"))
    kind = _field("WARC-Type")
    body = F.when(kind == "response", F.col("payload")).otherwise(F.lit(b""))
    return out.select(
        "id",
        "header",
        "payload",
        F.concat(F.encode("header", "UTF-8"), body, F.lit((2 * _CRLF).encode())).alias("record"),
        kind.alias("record_type"),
        F.when(F.replace(_field("WARC-Payload-Digest"), F.lit("sha256:"), F.lit("")) == F.col("checked"), F.col("checked")).otherwise(F.raise_error(F.lit("a header's digest isn't its payload's")).cast("string")).alias("payload_digest"),
        "payload_bytes",
        _field("X-Refers-To-Page").cast("long").alias("refers_to"),
        _field("WARC-Target-URI").alias("url"),
    )


def new_root(spark: SparkSession) -> str:
    """A fresh folder that all executors see."""
    return f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
