"""A stored inverted index for BM25, in segments that grow batch by batch, searched with block-max pruning.

Layout below a root: ``postings/segment=s/bucket=b`` holds blocks, ``documents/segment=s`` the ids of a segment, ``ledger/segment=s`` one row that
makes the segment count (documents, their tokens, segments that it replaces) and is written last: what has no row there isn't read.

A segment's documents are dealt to windows by length and a hash of the id, so that a window's documents score alike and no term, however frequent,
brings more than one window to a task. A block is what one term has in one window: postings (id, tf, dl), and their *front*, the pairs (tf, dl) that no other
posting of the block beats in both. Statistics change as segments come, and contributions with them; but a contribution grows with tf and falls with dl, so the
highest of a block is always found on its front.

A segment is written with one exchange: documents, counted in their rows, go to the task of their windows. Merging segments takes their blocks over where they are.

A search reads the buckets of its terms only. Fronts bound what a window can score for each query; the few windows of the highest bounds are scored first, which
gives a score that the last hit must reach, and all windows whose bound reaches it are scored then. Scores, order and rows are those of ``retrieval.bm25``.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.text import english_tokens
from siltstone.operators.retrieval import K1, B, query_term_lists, ranked
from siltstone.sources.shared import children, delete, exists

#: Term buckets of a new index, and about how many documents of one length a window holds at most.
BUCKETS, WINDOW = 64, 4096
#: Groups that the buckets are dealt to, and windows of one length that a task writes of such a group.
GROUPS, WRITTEN = 8, 16
#: Ids that are hinted for broadcast at most.
KNOWN = 500_000
#: Windows per query that are scored first, and how many may be named in a filter that reaches the files.
FIRST, NAMED = 4, 500
#: What rounding to six places can add to a sum of contributions.
SLACK = 1e-4

#: Stands between the terms of a document where they move.
BETWEEN = "\x00"

_LEDGER = "n long, tokens long, buckets int, replaces array<string>"


@dataclass(frozen=True)
class Segment:
    name: str
    n: int
    tokens: int
    buckets: int


@dataclass
class SearchIndex:
    """An index under ``root``; ids are of the type that ``id_type`` names."""

    spark: SparkSession
    root: str
    id_type: str = "long"
    id_col: str = "chunk_id"

    # ---- what there is ------------------------------------------------------------------------------------

    def segments(self) -> list[Segment]:
        """Committed segments that no later one replaces. One small row each; ``compact`` keeps them few."""
        names = [c for c in children(self.spark, f"{self.root}/ledger") if c.startswith("segment=") and exists(self.spark, f"{self.root}/ledger/{c}/_SUCCESS")]
        if not names:
            return []
        rows = self.spark.read.schema(_LEDGER + ", segment string").option("basePath", f"{self.root}/ledger").json([f"{self.root}/ledger/{c}" for c in names]).collect()
        gone = {s for r in rows for s in r["replaces"]}
        return sorted((Segment(r["segment"], r["n"], r["tokens"], r["buckets"]) for r in rows if r["segment"] not in gone), key=lambda s: s.name)

    def _table(self, kind: str, schema: str, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{kind}").parquet(*[f"{self.root}/{kind}/{p}" for p in parts])

    def _ids(self, live: list[Segment]) -> DataFrame:
        return self._table("documents", f"id {self.id_type}, segment string", [f"segment={s.name}" for s in live])

    def blocks(self, live: list[Segment] | None = None, buckets: list[int] | None = None) -> DataFrame:
        """All blocks, or those of some buckets, whose folders are then the only ones that are listed and read."""
        kinds = f"term string, window long, n long, said long, front array<struct<tf:long,dl:long>>, postings array<struct<id:{self.id_type},tf:long,dl:long>>, segment string, bucket int"
        parts = [f"segment={s.name}" for s in (self.segments() if live is None else live)]
        if buckets is not None:
            parts = [f"{p}/bucket={b}" for p in parts for b in buckets if exists(self.spark, f"{self.root}/postings/{p}/bucket={b}")]
        return self._table("postings", kinds, parts)

    def documents(self) -> DataFrame:
        return self._ids(self.segments())

    def statistics(self) -> tuple[int, float]:
        """(documents, their average tokens) of the committed segments."""
        live = self.segments()
        n = sum(s.n for s in live)
        return n, sum(s.tokens for s in live) / n if n else 0.0

    def frequencies(self) -> DataFrame:
        """(term, df) of all terms."""
        return self.blocks().groupBy("term").agg(F.sum("n").alias("df"))

    # ---- writing ------------------------------------------------------------------------------------------

    def _commit(self, segment: str, n: int, tokens: int, buckets: int, replaces: list[str]) -> None:
        row = self.spark.createDataFrame([(n, tokens, buckets, replaces)], _LEDGER)
        row.coalesce(1).write.mode("overwrite").json(f"{self.root}/ledger/segment={segment}")

    def _block(self, grouped: Any, of: Column) -> DataFrame:
        """Blocks of groups whose postings are ``of``, an array of (tf, short, id), where short is the length below zero."""
        # no pair of the front is beaten in both: of each tf the least dl, and of those only what is shorter than all with a higher tf
        best = F.aggregate(F.col("held"), F.array().cast("array<struct<tf:long,dl:long>>"), lambda acc, x: F.when((F.size(acc) == 0) | (-x["short"] < F.element_at(acc, -1)["dl"]), F.concat(acc, F.array(F.struct(x["tf"].alias("tf"), (-x["short"]).alias("dl"))))).otherwise(acc))
        held = grouped.agg(F.reverse(F.array_sort(of)).alias("held"))
        said = F.aggregate("held", F.lit(0).cast("long"), lambda acc, x: acc + x["tf"])
        return held.select("bucket", "term", "window", F.size("held").cast("long").alias("n"), said.alias("said"), best.alias("front"), F.transform("held", lambda x: F.struct(x["id"].alias("id"), x["tf"].alias("tf"), (-x["short"]).alias("dl"))).alias("postings"))

    def _write_blocks(self, block: DataFrame, segment: str) -> int:
        """Blocks -> the segment's files; how many tokens they stand for."""
        at = f"{self.root}/postings/segment={segment}"
        # sorted, so pages of a file can be skipped by their least and greatest term
        block.sortWithinPartitions("bucket", "term", "window").write.mode("overwrite").partitionBy("bucket").parquet(at)
        return self.spark.read.parquet(at).agg(F.sum("said")).first()[0] or 0 if any(c.startswith("bucket=") for c in children(self.spark, at)) else 0

    def _blocks_of(self, src: DataFrame, tokens: Callable[[Column], Column], buckets: int, windows: int) -> DataFrame:
        """src (id, text) -> the blocks of its terms. A document is counted in its row and moves once, as its terms in one text a group of buckets, to the task
        that has its windows: no posting is a row before it is where its block is made."""
        groups, slots = min(GROUPS, buckets), -(-windows // WRITTEN)
        said = src.select("id", F.array_sort(tokens(F.col("text"))).alias("said"))
        last = F.size("said") - 1
        # places where another term begins
        begun = F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), lambda i: (i == 0) | (F.get("said", i) != F.get("said", i - 1))))
        told = said.select("id", "said", F.size("said").alias("dl"), begun.alias("begun"))
        bucket = lambda t: F.pmod(F.crc32(t), F.lit(buckets)).cast("int")
        until = F.concat(F.slice("begun", 2, F.greatest(F.size("begun"), F.lit(1))), F.array("dl"))
        counted = F.zip_with("begun", until, lambda i, k: F.struct(F.get("said", i).alias("term"), (k - i).alias("tf"), F.pmod(bucket(F.get("said", i)), F.lit(groups)).alias("group")))
        band = F.floor(2 * F.log2(1 + F.col("dl")))
        place = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(windows))
        rows = told.select("id", "dl", (band * windows + place).alias("window"), F.pmod(place, F.lit(slots)).cast("int").alias("slot"), counted.alias("counted"))

        def part(g: int) -> Column:
            own = F.filter("counted", lambda x: x["group"] == g)
            return F.struct(F.lit(g).alias("group"), F.array_join(F.transform(own, lambda x: x["term"]), BETWEEN).alias("terms"), F.transform(own, lambda x: x["tf"]).alias("tfs"))

        parts = F.filter(F.array(*[part(g) for g in range(groups)]), lambda x: F.size(x["tfs"]) > 0)
        moved = rows.select("id", "dl", "window", "slot", F.explode(parts).alias("x")).select((F.col("x.group") * slots + F.col("slot")).alias("task"), "id", "dl", "window", "x.terms", "x.tfs")
        moved = moved.repartitionById(groups * slots, F.col("task"))
        terms = F.split("terms", BETWEEN, -1)
        whole = F.when(F.size(terms) == F.size("tfs"), terms).otherwise(F.raise_error(F.lit("a token holds the character of code 0")).cast("array<string>"))
        each = moved.select("task", "id", "dl", "window", F.inline(F.zip_with(whole, F.col("tfs"), lambda t, k: F.struct(t.alias("term"), k.cast("long").alias("tf")))))
        grouped = each.withColumn("bucket", bucket(F.col("term"))).groupBy("task", "bucket", "term", "window")
        return self._block(grouped, F.collect_list(F.struct("tf", (-F.col("dl")).cast("long").alias("short"), "id")))

    def add(self, docs: DataFrame, segment: str | None = None, text: str = "bm25_text", tokens: Callable[[Column], Column] = english_tokens, buckets: int = BUCKETS) -> str:
        """Indexes ``docs`` (id, text) as one segment and commits it. A segment that is committed already stays as it is, whatever ``docs`` hold; one that was begun and
        not committed is written anew. Rows without an id are left out; ids must be distinct and new (``add_new`` sees to that). Texts are tokenised once."""
        name = segment or uuid.uuid4().hex
        live = self.segments()
        if name in {s.name for s in live} or exists(self.spark, f"{self.root}/ledger/segment={name}/_SUCCESS"):
            return name
        buckets = live[0].buckets if live else buckets
        src = docs.where(F.col(self.id_col).isNotNull()).select(F.col(self.id_col).cast(self.id_type).alias("id"), F.col(text).alias("text"))
        ids = f"{self.root}/documents/segment={name}"
        src.select("id").write.mode("overwrite").parquet(ids)
        n = self.spark.read.schema(f"id {self.id_type}").parquet(ids).count()
        said = self._write_blocks(self._blocks_of(src, tokens, buckets, max(1, -(-n // WINDOW))), name)
        self._commit(name, n, said, buckets, [])
        return name

    def add_new(self, docs: DataFrame, segment: str, text: str = "bm25_text", **more: Any) -> str:
        """``add`` for deliveries that may repeat: of rows with one id that of the least text counts, and ids that a committed segment has are left out."""
        live = self.segments()
        if segment in {s.name for s in live} or exists(self.spark, f"{self.root}/ledger/segment={segment}/_SUCCESS"):
            return segment
        own = docs.where(F.col(self.id_col).isNotNull()).select(F.col(self.id_col).cast(self.id_type).alias(self.id_col), text)
        # only ids are compared; texts move where many of them repeat or are known
        ids = own.groupBy(self.id_col).agg(F.count(F.lit(1)).alias("k"))
        known = self._ids(live).select(F.col("id").alias(self.id_col), F.lit(True).alias("known"))
        odd = ids.join(known, self.id_col, "left").where("k > 1 or known").select(self.id_col, F.coalesce("known", F.lit(False)).alias("known"))
        told = odd.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("known")).alias("repeated")).first()
        few = F.broadcast if told["n"] <= KNOWN else (lambda df: df)
        once = own.join(few(odd.select(self.id_col)), self.id_col, "left_anti") if told["n"] else own
        if told["repeated"]:
            again = own.join(few(odd.where("not known").select(self.id_col)), self.id_col, "left_semi")
            once = once.unionByName(again.groupBy(self.id_col).agg(F.min(text).alias(text)))
        return self.add(once, segment, text, **more)

    def compact(self, segment: str | None = None) -> str | None:
        """All segments as one, whose row in the ledger replaces theirs; texts aren't read. Their files are deleted afterwards by ``sweep``."""
        live = self.segments()
        if len(live) < 2:
            return None
        name = segment or uuid.uuid4().hex
        self._ids(live).select("id").write.mode("overwrite").parquet(f"{self.root}/documents/segment={name}")
        n = sum(s.n for s in live)
        said = self._write_blocks(self._merged(live), name)
        self._commit(name, n, said, live[0].buckets, [s.name for s in live])
        return name

    def _merged(self, live: list[Segment]) -> DataFrame:
        """Blocks of all these segments. Windows of a segment that has filled some are taken over block by block, and nothing moves; smaller segments are put together, as
        many as fill a window, and their blocks of one length made one."""
        pools: list[list[Segment]] = []
        for s in sorted((s for s in live if s.n < WINDOW), key=lambda s: s.name):
            if not pools or sum(x.n for x in pools[-1]) + s.n > WINDOW:
                pools.append([])
            pools[-1].append(s)
        pooled = {s.name for p in pools if len(p) > 1 for s in p}
        named = F.xxhash64("segment", "window")
        kept = [s for s in live if s.name not in pooled]
        out = self.blocks(kept).select("bucket", "term", named.alias("window"), "n", "said", "front", "postings")
        if not pooled:
            return out
        pool = F.create_map(*[F.lit(x) for p in pools if len(p) > 1 for s in p for x in (s.name, p[0].name)])
        small = self.blocks([s for s in live if s.name in pooled]).withColumn("window", F.xxhash64(pool[F.col("segment")], "window"))
        lists = F.flatten(F.collect_list(F.transform("postings", lambda x: F.struct(x["tf"].alias("tf"), (-x["dl"]).alias("short"), x["id"].alias("id")))))
        made = self._block(small.groupBy("bucket", "term", "window"), lists)
        return made if not kept else out.unionByName(made)

    def sweep(self) -> list[str]:
        """Deletes files of segments that are replaced, and of such that were begun but never committed: for when no search or writer is under way."""
        live = {s.name for s in self.segments()}
        found = sorted({c.removeprefix("segment=") for kind in ("postings", "documents") for c in children(self.spark, f"{self.root}/{kind}") if c.startswith("segment=")} - live)
        for name in found:
            for kind in ("postings", "documents"):
                delete(self.spark, f"{self.root}/{kind}/segment={name}")
        return found

    # ---- searching ----------------------------------------------------------------------------------------

    def postings_of(self, terms: list[str], live: list[Segment] | None = None) -> DataFrame:
        """The blocks of ``terms``: their buckets are the only folders read."""
        live = self.segments() if live is None else live
        buckets = sorted({zlib.crc32(t.encode()) % live[0].buckets for t in terms}) if live else []
        return self.blocks(live, buckets).where(F.col("term").isin(*terms))

    def search(self, queries: DataFrame, limit: int | None = 10, allowed: DataFrame | None = None, first: int = FIRST, tokens: Callable[[Column], Column] = english_tokens, told: dict[str, int] | None = None) -> DataFrame:
        """queries (query_id, query; at most ``retrieval.MAX_FANOUT``) -> (query_id, id, matched_terms, rank, score), the rows of ``retrieval.bm25``. ``allowed`` (id)
        restricts candidates, not statistics. Without a limit nothing can be left out. ``told`` is given the numbers of windows there were and that were scored."""
        asked = [(i, ts) for i, ts in query_term_lists(queries, tokens(F.col("query"))) if ts]
        terms = sorted({t for _, ts in asked for t in ts})
        live = [s for s in self.segments() if s.n]
        kind = queries.schema["query_id"].dataType
        if not terms or not live:
            none = T.StructType([T.StructField("query_id", kind), *self.spark.createDataFrame([], f"{self.id_col} {self.id_type}, matched_terms array<string>, rank int, score double").schema])
            return self.spark.createDataFrame([], none)
        n = sum(s.n for s in live)
        average = sum(s.tokens for s in live) / n
        blocks = self.postings_of(terms, live)
        df = {r["term"]: r["df"] for r in blocks.groupBy("term").agg(F.sum("n").alias("df")).collect()}
        weight = F.create_map(*[x for t in terms for x in (F.lit(t), F.log(1 + (F.lit(n) - F.lit(df.get(t, 0)) + 0.5) / (F.lit(df.get(t, 0)) + 0.5)))])

        def part(tf: Column, dl: Column) -> Column:
            return F.round(weight[F.col("term")] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.greatest(F.lit(average), F.lit(1.0)))), 6)

        def scored(some: DataFrame) -> DataFrame:
            """(query_id, id, raw, matched_terms) of all documents in these blocks; contributions are summed in the order of the terms."""
            each = some.select("term", F.inline("postings")).select("id", "term", part(F.col("tf"), F.col("dl")).alias("part"))
            if allowed is not None:
                each = each.join(allowed.select(F.col(self.id_col).cast(self.id_type).alias("id")), "id", "left_semi")
            by_id = each.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("term", "part"))).alias("parts"))

            def one(query_id: Any, own: list[str]) -> Column:
                mine = F.filter("parts", lambda x: x["term"].isin(*own))
                return F.struct(F.lit(query_id).cast(kind).alias("query_id"), F.aggregate(mine, F.lit(0.0), lambda acc, x: acc + x["part"]).alias("raw"), F.transform(mine, lambda x: x["term"]).alias("matched_terms"))

            per = F.filter(F.array(*[one(i, ts) for i, ts in asked]), lambda x: x["raw"] > 0)
            return by_id.select(F.col("id").alias(self.id_col), F.explode(per).alias("x")).select("x.query_id", self.id_col, "x.raw", "x.matched_terms")

        if limit is None:
            return ranked(scored(blocks), None, self.id_col)
        highest = F.aggregate("front", F.lit(0.0), lambda acc, x: F.greatest(acc, part(x["tf"], x["dl"])))
        tops = blocks.select("segment", "window", "term", highest.alias("top"))
        bounds = tops.groupBy("segment", "window").agg(*[F.sum(F.when(F.col("term").isin(*ts), F.col("top"))).alias(f"b{k}") for k, (_, ts) in enumerate(asked)])
        each = bounds.select("segment", "window", F.posexplode(F.array(*[F.col(f"b{k}") for k in range(len(asked))])).alias("query_id", "raw")).where("raw is not null")
        best = ranked(each.withColumn("at", F.struct("segment", "window")), first, "at").select("segment", "window").distinct().collect()
        floor = {r["query_id"]: r["raw"] for r in ranked_raw(scored(blocks.where(_named(best))), limit, self.id_col).where(F.col("rank") == limit).collect()}
        reach = F.lit(False)
        for k, (i, _) in enumerate(asked):
            reach = reach | F.coalesce(F.col(f"b{k}") >= floor.get(i, 0.0) - SLACK, F.lit(False))
        alive = bounds.where(reach).select("segment", "window")
        few = alive.limit(NAMED + 1).collect()
        if told is not None:
            told |= {"windows": bounds.count(), "scored": len(few) if len(few) <= NAMED else alive.count()}
        some = blocks.where(_named(few)) if len(few) <= NAMED else blocks.join(alive, ["segment", "window"], "left_semi")
        return ranked(scored(some), limit, self.id_col)


def ranked_raw(scored: DataFrame, limit: int, id_col: str) -> DataFrame:
    """As ``ranked``, with the sum that it ranks by."""
    return ranked(scored.withColumn("sum", F.col("raw")), limit, id_col).withColumnRenamed("sum", "raw")


def _named(windows: list[Any]) -> Column:
    """Blocks of these windows, as a filter whose windows reach the files."""
    if not windows:
        return F.lit(False)
    by: dict[str, list[int]] = {}
    for r in windows:
        by.setdefault(r["segment"], []).append(r["window"])
    own = F.lit(False)
    for s, ws in by.items():
        own = own | ((F.col("segment") == s) & F.col("window").isin(*ws))
    return F.col("window").isin(*sorted({w for ws in by.values() for w in ws})) & own
