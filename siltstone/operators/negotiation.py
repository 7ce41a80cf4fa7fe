"""Field candidates: what a schema and its feedback propose, checked against tasks and data before a field is taken up."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.operators import aggregates, filters, retrieval
from siltstone.operators.feedback import decide
from siltstone.schemas import NOT_MENTIONED, Catalog, FieldSpec

# Words that a candidate's terms leave out, and what an evaluation may say.
CANDIDATE_STOPWORDS = ("the", "and", "for", "with", "calls", "call")
VERDICTS = ("accept", "revise", "reject", "human_review")
#: Calls that must bear a candidate out before it is promoted without a look.
ENOUGH = 3


def candidate_terms(text: str) -> list[str]:
    return [w for w in text.lower().replace("_", " ").split() if len(w) > 2 and w not in CANDIDATE_STOPWORDS]


def candidates(report: DataFrame, wishes: DataFrame) -> DataFrame:
    """A quality report (field_name, support_call_count, status) full-joined by name with wished fields (field_name, count): where each
    comes from, how much bears it out, whether that is uncertain, and the decision."""
    both = report.join(wishes.select("field_name", F.col("count").alias("requests")), "field_name", "full")
    source = F.when(F.col("support_call_count").isNull(), "feedback").when(F.col("requests").isNull(), "schema").otherwise("schema+feedback")
    support = F.coalesce("support_call_count", F.lit(0)).cast("long")
    told = both.select("field_name", source.alias("source"), support.alias("support"), F.coalesce("requests", F.lit(0)).cast("long").alias("requests"), F.coalesce("status", F.lit("hold")).alias("status"), F.lit(None).cast("string").alias("duplicate_of"))
    return decide(told.withColumn("uncertain", F.col("support") == 0))


def candidate_details(spec: FieldSpec) -> dict[str, Any]:
    """What a candidate would be used for: questions, an example filter, an example aggregate, and the evidence it needs."""
    value = True if spec.type == "boolean" else next((v for v in spec.allowed_values if v != NOT_MENTIONED), None)
    label = spec.name.replace("_", " ")
    return {
        "field_name": spec.name,
        "intended_queries": list(spec.downstream_use_cases) or [f"Which calls have {label}?"],
        "example_filters": {spec.name: value} if spec.filterable and value is not None else {},
        "example_aggregation": f"group_count(records, '{spec.name}')" if spec.aggregatable else None,
        "evidence_requirements": "every value names a chunk that holds it",
    }


#: Terms have so many letters at least, and are looked for by so many of their first letters at most.
PIECE, KEY = 3, 6
#: A run of a task's letters is read in stretches of so many letters, or of the longest term's, if that has more. At most so many ranges name the letters.
STRETCH, RANGES = 64, 64
#: Terms are hinted for broadcast up to so many rows and bytes.
FEW_ROWS, FEW_BYTES = 200_000, 16 << 20


def _letters_of(terms: DataFrame) -> str:
    """A character class of all letters that ``terms`` are made of; of more than RANGES ranges the nearest are made one, which only adds letters."""
    found = sorted(ord(r["c"]) for r in terms.select(F.explode(F.array_distinct(F.regexp_extract_all("term", F.lit("(?s)."), F.lit(0)))).alias("c")).distinct().collect())
    ranges = [[c, c] for c in found or [0]]
    gap = sorted(b[0] - a[1] for a, b in zip(ranges, ranges[1:]))
    least = max(1, gap[-RANGES]) if len(gap) >= RANGES else 1
    merged = ranges[:1]
    for lo, hi in ranges[1:]:
        if lo - merged[-1][1] <= least:
            merged[-1][1] = hi
        else:
            merged.append([lo, hi])
    return "[" + "".join(f"\\x{{{lo:x}}}-\\x{{{hi:x}}}" for lo, hi in merged) + "]"


def _first(rows: DataFrame, key: str, most: int) -> DataFrame:
    """Of each ``key`` the rows of its ``most`` least places; tasks leave out what can't be among them before rows move."""
    return rows.withColumn("_k", F.dense_rank().over(Window.partitionBy(key).orderBy("ordinal"))).where(F.col("_k") <= most).select(key, "ordinal").distinct()


def matching_tasks(wanted: DataFrame, tasks: DataFrame, most: int = 6) -> DataFrame:
    """wanted (field_name, terms) and tasks (ordinal, query) -> (field_name, tasks): the first ``most`` tasks whose query holds any of the terms as a
    substring.

    A term lies within a run of letters that terms are made of, so queries are cut into such runs, long ones into stretches that overlap by the longest term.
    The first tasks of a term are among the first tasks of each run that holds it: only those are kept of a run, and terms are looked for in distinct runs, by their first letters,
    not in queries. Reading is linear in the queries' length, and what moves are at most ``most`` places a run and task. Terms of under three letters are left out; rows that repeat a
    place are one task."""
    terms = wanted.select("field_name", F.explode("terms").alias("term")).where(F.length("term") >= PIECE).distinct()
    own = terms.select("term").distinct()
    size = own.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("term")).alias("held"), F.max(F.length("term")).alias("longest")).first()
    longest = size["longest"] or PIECE
    step = max(STRETCH, longest)
    letter = _letters_of(own)
    low = tasks.where("ordinal is not null and query is not null").select("ordinal", F.lower("query").alias("low"))
    runs = F.regexp_extract_all("low", F.lit(f"(?=({letter}{{{PIECE},{step + longest - 1}}})){letter}{{1,{step}}}"), F.lit(1))
    said = _first(low.select("ordinal", F.explode(F.array_distinct(runs)).alias("run")), "run", most)
    by_run = said.groupBy("run").agg(F.collect_list("ordinal").alias("places"))
    of = lambda k: F.transform(F.sequence(F.lit(1), F.length("run") - (k - 1)), lambda at: F.substring("run", at, F.lit(k)))
    pieces = F.array_distinct(F.concat(*[F.when(F.length("run") >= k, of(k)).otherwise(F.array().cast("array<string>")) for k in range(PIECE, KEY + 1)]))
    cut = by_run.select("run", "places", F.explode(pieces).alias("piece"))
    begun = own.withColumn("piece", F.substring("term", 1, KEY))
    few = size["n"] <= FEW_ROWS and (size["held"] or 0) <= FEW_BYTES
    met = cut.join(F.broadcast(begun) if few else begun, "piece").where(F.contains("run", "term"))
    of_term = _first(met.select("term", F.explode("places").alias("ordinal")), "term", most)
    hits = _first(of_term.join(terms, "term"), "field_name", most)
    return hits.groupBy("field_name").agg(F.array_sort(F.collect_list("ordinal")).alias("tasks"))


def _tried(what: Any) -> tuple[int, str | None]:
    try:
        return what(), None
    except ValueError as e:
        return 0, str(e)


def evaluate(candidate: dict[str, Any], silver: DataFrame, documents: DataFrame, catalog: Catalog, tasks: DataFrame, limit: int = 5) -> dict[str, Any]:
    """Simulates what a candidate promises: its filter, its aggregate, a search for its name; and looks for tasks that would use it. It is accepted
    if a task wants it and filter or aggregate finds something, retrieval_only if just the search does."""
    spark, name = silver.sparkSession, candidate["field_name"]
    given = candidate.get("example_filters") or {}
    records, filter_fault = _tried(lambda: filters.query_silver(silver, filters.validate_filters(given, catalog)).count() if given else 0)
    expression = candidate.get("example_aggregation")
    groups, aggregate_fault = _tried(lambda: aggregates.evaluate(expression, silver, catalog).frame.count() if expression else 0)
    terms = candidate_terms(" ".join([name, *candidate.get("intended_queries", [])]))
    q = spark.createDataFrame([(0, " ".join(candidate_terms(name)) or name)], "query_id int, query string")
    chunks = retrieval.bm25(documents, q, limit).count()
    wanted = spark.createDataFrame([(name, terms)], "field_name string, terms array<string>")
    found = matching_tasks(wanted, tasks).first()
    uses = list(found["tasks"]) if found else []
    decision = "promote" if uses and (records or groups) else "retrieval_only" if chunks and not (records or groups) else "human_review" if records or groups else "defer"
    return {"field_name": name, "filter_records": records, "aggregation_groups": groups, "search_chunks": chunks, "matching_tasks": uses, "faults": [f for f in (filter_fault, aggregate_fault) if f], "decision": decision}


def checked_verdict(output: Any, known: set[str]) -> dict[str, Any]:
    """A model's verdict on a candidate, or ValueError: a known field, an allowed verdict, a confidence within 0..1 and a reason."""
    if not isinstance(output, dict):
        raise ValueError("a verdict must be an object")
    name, verdict, sure = output.get("field_name"), output.get("verdict"), output.get("confidence", 0.0)
    if name not in known:
        raise ValueError(f"unknown candidate: {name!r}")
    if verdict not in VERDICTS:
        raise ValueError(f"verdict not allowed: {verdict!r}")
    if isinstance(sure, bool) or not isinstance(sure, (int, float)) or not 0 <= sure <= 1:
        raise ValueError("confidence must be within 0..1")
    return {"field_name": name, "verdict": verdict, "confidence": float(sure), "reason": str(output.get("reason", ""))}


def read_candidates(spark: SparkSession, path: str) -> list[dict[str, Any]]:
    """Candidates published as one JSON array in a file, or in a folder's ``field_candidates``; none if there is no such file."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    for at in (f"{path.rstrip('/')}/field_candidates.json", f"{path.rstrip('/')}/field_candidates", path):
        where = hadoop(at)
        fs = where.getFileSystem(conf)
        if fs.exists(where) and (fs.getFileStatus(where).isFile() or at != path):
            got = json.loads("\n".join(r["value"] for r in spark.read.option("wholetext", True).text(at).collect()))
            if not isinstance(got, list):
                raise ValueError("field candidates must be a JSON array")
            return got
    return []

