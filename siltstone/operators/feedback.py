"""Feedback merging, negotiation, usage, loop metrics and redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.text import collapsed, normalize_identifier, normalize_label, suggested_values

# Ranks by which merged requests are decided, and keys hidden in replays.
PRIORITY = {"low": 1, "medium": 2, "high": 3}
ACTION = {"add_field": 3, "improve_extraction": 2, "add_allowed_values": 1}
TYPE = {"string": 3, "list": 2, "enum": 1, "boolean": 0}
SENSITIVE = ("text", "snippet", "bm25_text", "embedding_text", "transcript", "best_text")
REDACTED = "[redacted]"
#: Flags of a judgement, and all that is normalised in one.
FLAGS = ("answerable", "evidence_sufficient", "success", "needs_cu_feedback")
JUDGED = (*FLAGS, "confidence", "failure_modes")


def _rank(c: Column, ranks: dict[str, int]) -> Column:
    out = F.lit(0)
    for k, v in ranks.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def _top(name: str, ranks: dict[str, int]) -> Column:
    """The value of the highest rank; the earliest of equals."""
    return F.max_by(F.col(name), F.struct(_rank(F.col(name), ranks), -F.col("ordinal"))).alias(name)


def merge_requests(requests: DataFrame, most_values: int = 24) -> DataFrame:
    """Requests (ordinal, field_name, action, field_type, priority, description, suggested_allowed_values) ->
    one per normalised name: highest priority, action and type by rank, longest description (earliest of
    equals), and the first ``most_values`` values in first-seen order. Values are counted as rows: however many a name has, no more than those asked for come together."""
    r = requests.withColumn("field_name", normalize_identifier("field_name")).where("field_name <> ''")
    out = r.groupBy("field_name").agg(
        _top("priority", PRIORITY), _top("action", ACTION), _top("field_type", TYPE), F.max_by("description", F.struct(F.length("description"), -F.col("ordinal"))).alias("description"), F.count(F.lit(1)).alias("count"),
    )
    each = r.select("field_name", "ordinal", F.posexplode("suggested_allowed_values").alias("pos", "value")).where("value is not null")
    first = each.groupBy("field_name", "value").agg(F.min(F.struct("ordinal", "pos")).alias("at"))
    kept = first.withColumn("place", F.row_number().over(Window.partitionBy("field_name").orderBy("at"))).where(F.col("place") <= most_values)
    values = kept.groupBy("field_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("suggested_allowed_values"))
    out = out.join(values, "field_name", "left").withColumn("suggested_allowed_values", F.coalesce("suggested_allowed_values", F.array().cast("array<string>")))
    return out.orderBy(F.desc(_rank(F.col("priority"), PRIORITY)), "field_name")


def error_histogram(rows: DataFrame, column: str = "validation_errors") -> DataFrame:
    return rows.select(F.explode(column).alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("count")).orderBy("error")


def decide(candidates: DataFrame) -> DataFrame:
    """Candidates (name, duplicate_of, uncertain, status, support) with a decision: merge, then human_review, promote, retrieval_only, defer."""
    return candidates.withColumn("decision", F.when(F.col("duplicate_of").isNotNull(), "merge").when(F.col("uncertain"), "human_review").when(F.col("status") == "promote", "promote").when(F.col("support") > 0, "retrieval_only").otherwise("defer"))


def usage_rollup(calls: DataFrame, rates: dict[str, tuple[float, float]]) -> DataFrame:
    """(model, input_tokens, output_tokens) -> calls, tokens and cost by model; rates are USD per million."""
    cost = F.lit(None).cast("double")
    for m, (i, o) in rates.items():
        cost = F.when(F.col("model") == m, (F.col("input_tokens") * i + F.col("output_tokens") * o) / 1e6).otherwise(cost)
    return calls.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum(cost), 10).alias("cost_usd"))


def first_wins(frames: list[DataFrame], key: str, order: str) -> DataFrame:
    """Union by key: the earliest frame, then the least ``order``, keeps the row."""
    both = None
    for i, f in enumerate(frames):
        g = f.withColumn("_src", F.lit(i))
        both = g if both is None else both.unionByName(g)
    cols = [c for c in both.columns if c not in (key, "_src")]
    best = both.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct("_src", order)).alias("r"))
    return best.select(key, "r.*")


def task_key(query: str) -> Column:
    return F.lower(collapsed(query))


def redacted(df: DataFrame, keys: tuple[str, ...] = SENSITIVE) -> DataFrame:
    """Values that aren't empty under sensitive names become "[redacted]", at any depth; the schema stays."""

    def hide(c: Column, kind: T.DataType, name: str | None) -> Column:
        if name in keys and isinstance(kind, T.StringType):
            return F.when(c.isNull() | (c == ""), c).otherwise(F.lit(REDACTED))
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[hide(c[f.name], f.dataType, f.name).alias(f.name) for f in kind.fields]))
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: hide(x, kind.elementType, name))
        if isinstance(kind, T.MapType) and isinstance(kind.valueType, T.StringType):
            return F.transform_values(c, lambda k, v: F.when(k.isin(*keys) & v.isNotNull() & (v != ""), F.lit(REDACTED)).otherwise(v))
        return c

    return df.select(*[hide(F.col(f"`{f.name}`"), f.dataType, f.name).alias(f.name) for f in df.schema.fields])


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """(key, count) by key: lists are taken apart, empty values left out."""
    kind = dict(rows.dtypes)[column]
    value = F.explode(column) if kind.startswith("array") else F.col(column)
    keyed = rows.select(value.alias("v")).select(F.col("v").cast("string").alias("key")).where("key is not null and key not in ('', 'not_mentioned')")
    return keyed.groupBy("key").agg(F.count(F.lit(1)).alias("count")).orderBy("key")


def schema_delta(before: DataFrame, after: DataFrame, key: str = "field_name") -> DataFrame:
    """(change, field_name): what a schema gained and lost."""
    a, b = before.select(key).distinct(), after.select(key).distinct()
    return b.join(a, key, "left_anti").select(F.lit("added").alias("change"), key).unionByName(a.join(b, key, "left_anti").select(F.lit("removed").alias("change"), key))


def observed_columns(names: list[str], more: list[str]) -> list[str]:
    return sorted({*names, *more})


def usage_deltas(usage: DataFrame) -> DataFrame:
    """Running totals (run_id, ordinal, input_tokens, output_tokens) -> what each entry added to its run's last."""
    w = Window.partitionBy("run_id").orderBy("ordinal")
    added = lambda c: (F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0)))
    return usage.withColumn("input_delta", added("input_tokens")).withColumn("output_delta", added("output_tokens"))


def last_entries(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last ``n`` rows of each key by ``order``."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("_k") <= n).drop("_k")


def distinct_failures(failures: DataFrame) -> DataFrame:
    """Failures (ordinal, reason, ...) once a reason, the first one's; blank reasons go."""
    f = failures.withColumn("reason", F.trim("reason")).where("reason <> ''")
    rest = [c for c in f.columns if c != "reason"]
    return f.groupBy("reason").agg(F.min_by(F.struct(*rest), "ordinal").alias("_f")).select("reason", "_f.*")


def normalized_judgements(rows: DataFrame) -> DataFrame:
    """Judgements with defaults: flags false, confidence low unless it is medium or high, lists empty."""
    j = rows.select(*[c for c in rows.columns if c not in JUDGED], *[F.coalesce(F.col(c).cast("boolean"), F.lit(False)).alias(c) if c in rows.columns else F.lit(False).alias(c) for c in FLAGS])
    sure = F.lower(F.col("confidence")) if "confidence" in rows.columns else F.lit(None).cast("string")
    modes = F.array_distinct(F.filter(F.transform("failure_modes", lambda m: F.trim(m)), lambda m: m != "")) if "failure_modes" in rows.columns else F.array().cast("array<string>")
    own = rows.select("ordinal", F.when(sure.isin("medium", "high"), sure).otherwise("low").alias("confidence"), F.coalesce(modes, F.array().cast("array<string>")).alias("failure_modes"))
    return j.join(own, "ordinal")


def normalized_requests(rows: DataFrame) -> DataFrame:
    """Requests with a normalised name, known action, type and priority (else add_field, string and medium), and distinct, labelled values; without a name they go."""
    known = lambda c, given, d: F.when(F.lower(F.trim(c)).isin(*given), F.lower(F.trim(c))).otherwise(d)
    values = F.filter(F.array_distinct(F.transform("suggested_allowed_values", normalize_label)), lambda v: v != "")
    out = rows.withColumns({"field_name": normalize_identifier("field_name"), "action": known("action", ACTION, "add_field"), "field_type": known("field_type", TYPE, "string"), "priority": known("priority", PRIORITY, "medium"), "suggested_allowed_values": F.coalesce(values, F.array().cast("array<string>"))})
    return out.where("field_name <> ''")


def synthesized(answers: DataFrame) -> DataFrame:
    """Requests of answers (ordinal, query, column_requests, judge_requests, failures, needs_cu_feedback), by the first source that has any: what was asked for,
    by the plan or the judge; else one request from the failed searches; else one from a judgement that isn't satisfied."""
    none = F.array().cast(dict(answers.dtypes)["column_requests"])
    asked = F.concat(F.coalesce("column_requests", none), F.coalesce("judge_requests", none))
    values = suggested_values("query")
    kind = answers.schema["column_requests"].dataType.elementType
    told = {"action": F.lit("add_field"), "field_name": F.coalesce(F.nullif(F.array_join(F.slice(values, 1, 3), "_"), F.lit("")), F.lit("query_signal")), "field_type": F.lit("list"), "priority": F.lit("medium"), "suggested_allowed_values": values, "example_queries": F.array("query")}

    def made(reason: Column, priority: str) -> Column:
        own = told | {"reason": reason, "description": F.concat(F.lit("Signal that makes downstream queries expressible: "), "query"), "priority": F.lit(priority)}
        return F.array(F.struct(*[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields])).cast(answers.schema["column_requests"].dataType)

    failed = F.size(F.coalesce("failures", F.array().cast("array<string>"))) > 0
    from_failures = F.when(failed, made(F.concat(F.lit("searches failed: "), F.array_join(F.array_distinct("failures"), "; ")), "high"))
    from_judge = F.when(F.coalesce("needs_cu_feedback", F.lit(False)), made(F.lit("the judge asks for feedback"), "medium"))
    source = F.when(F.size(asked) > 0, "asked").when(from_failures.isNotNull(), "search_failures").when(from_judge.isNotNull(), "judgement")
    rows = answers.select("ordinal", source.alias("source"), F.coalesce(F.when(F.size(asked) > 0, asked), from_failures, from_judge, none).alias("_r"))
    return rows.select("ordinal", "source", F.explode("_r").alias("_r")).select("ordinal", "source", "_r.*")


def report(requests: DataFrame, specs: DataFrame, quality: DataFrame) -> DataFrame:
    """Merged requests marked: accepted if the schema has the field now, promoted if its quality was good enough."""
    in_schema = specs.select("field_name").distinct().withColumn("accepted", F.lit(True))
    good = quality.where("status = 'promote'").select("field_name").distinct().withColumn("promoted", F.lit(True))
    both = merge_requests(requests).join(in_schema, "field_name", "left").join(good, "field_name", "left")
    return both.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("accepted", "promoted")})


def repair_signals(quality: DataFrame, errors: DataFrame, calls: int, often: float = 0.2) -> DataFrame:
    """What a schema's or an extractor's prompt should be mended for: (target, field_name, signal, measure). Four rules over the report and the error histogram
    (error as ``field:code``): thin evidence, nothing found, values outside the allowed ones, faults of the model's answers."""
    field, code = F.substring_index("error", ":", 1), F.regexp_replace("error", "^[^:]*:", "")
    share = F.col("count") / F.lit(max(1, calls))
    thin = quality.where("support_call_count > 0 and status <> 'promote'").select(F.lit("extraction").alias("target"), "field_name", F.lit("thin_evidence").alias("signal"), F.col("evidence_coverage").alias("measure"))
    empty = quality.where("support_call_count = 0").select(F.lit("schema"), "field_name", F.lit("never_found"), F.lit(0.0))
    strange = errors.where(code.startswith("value_not_allowed")).groupBy(field.alias("f")).agg(F.sum("count").alias("count")).where(share >= often).select(F.lit("schema"), "f", F.lit("values_missing"), F.round(share, 4))
    faulty = errors.where(code.rlike("request_failed|_not_|^expected_|^invalid_|missing_field") & ~code.startswith("value_not_allowed")).groupBy(field.alias("f")).agg(F.sum("count").alias("count")).where(share >= often).select(F.lit("extraction"), "f", F.lit("malformed_answers"), F.round(share, 4))
    return thin.union(empty).union(strange).union(faulty)


def query_repair_signals(judged: DataFrame, often: float = 0.2) -> DataFrame:
    """(target, signal, count, share) from judgements (failure_modes): what the planner's, the search's or the answer's prompt should be mended for."""
    target = F.when(F.col("mode").isin("empty_aggregation", "no_records"), "planner").when(F.col("mode").isin("retrieval_failure", "search_only_schema_gap"), "search").when(F.col("mode") == "missing_evidence", "answer").when(F.col("mode").startswith("guardrail"), "planner")
    total = judged.agg(F.count(F.lit(1)).alias("all"))
    counts = judged.select(F.explode(F.array_distinct("failure_modes")).alias("mode")).groupBy("mode").agg(F.count(F.lit(1)).alias("count"))
    return counts.crossJoin(F.broadcast(total)).where(target.isNotNull() & (F.col("count") >= often * F.col("all"))).select(target.alias("target"), F.col("mode").alias("signal"), "count", F.round(F.col("count") / F.col("all"), 4).alias("share"))
