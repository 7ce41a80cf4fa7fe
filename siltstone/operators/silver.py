"""Rule extraction, quality gate, pivot to silver rows and catalog.

A call is one row with its chunks in order, so every rule of every field is a column of one projection;
the long table is an explode of it. Only the quality report aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import collapsed, contains_any
from siltstone.schemas import NOT_MENTIONED, Catalog, FieldSpec

SCHEMA_VERSION = "siltstone.silver.v1"
LEAST_COVERAGE = 0.75

# Keywords of list fields, and ordered rules of enum fields.
LIST_RULES = {
    "topic": {
        "call_search": ("search past", "transcript search", "searchable call", "call archive"),
        "crm_hygiene": ("crm", "salesforce", "hubspot", "account names", "opportunity"),
        "security_governance": ("security", "redaction", "retention", "audit", "access control", "sso"),
        "pipeline_review": ("pipeline", "deal", "prospect", "pricing blocked"),
        "support_analytics": ("support", "complaints", "escalation", "refund", "shipping", "mobile"),
        "campaign_analytics": ("campaign", "coupon", "marketing"),
        "customer_journey": ("journey", "onboarding", "adoption", "expansion"),
    },
    "pain_point": {
        "manual_work": ("manual work", "inconsistent notes", "summarize calls"),
        "crm_data_quality": ("duplicate account", "missing opportunity", "crm hygiene", "right salesforce account"),
        "privacy_or_access_control": ("access controls", "redaction", "regulated", "customer addresses", "raw transcripts"),
        "pricing_objection": ("pricing objection", "pricing blocked", "pricing pushback", "budget"),
        "integration_gap": ("integration", "bigquery", "transcripts are separate", "warehouse", "slack", "jira"),
        "complaint_theme": ("shipping delay", "coupon", "refund", "complaint", "mobile login"),
        "campaign_normalization": ("campaign names inconsistently", "campaign normalization"),
        "evidence_requirement": ("evidence span", "evidence snippets", "leadership will not trust"),
    },
    "product_area": {
        "search": ("search", "archive", "indexing"),
        "crm": ("crm", "salesforce", "hubspot", "opportunity"),
        "security": ("security", "sso", "audit", "redaction", "access control", "retention"),
        "integrations": ("integration", "slack", "jira", "bigquery", "warehouse", "api"),
        "analytics_dashboard": ("dashboard", "trend analysis", "weekly report", "cluster report"),
        "mobile_app": ("mobile app", "mobile login"),
        "campaigns": ("campaign", "coupon", "marketing"),
        "fulfillment": ("shipping", "warehouse", "refund"),
        "follow_up": ("next action", "follow-up", "owner"),
    },
    "integration_request": {k: (k,) for k in ("salesforce", "hubspot", "slack", "jira", "bigquery", "warehouse", "api")},
    "data_gap": {
        "duplicate_account_names": ("duplicate account",),
        "missing_opportunity_id": ("missing opportunity",),
        "missing_metadata_join": ("metadata", "separate"),
        "inconsistent_campaign_name": ("campaign names inconsistently", "campaign normalization"),
        "separate_transcript_store": ("transcripts are separate",),
        "evidence_span_required": ("evidence span", "evidence snippets", "will not trust"),
    },
    "complaint_theme": {
        "shipping_delay": ("shipping delay",),
        "coupon_confusion": ("coupon", "coupon codes"),
        "refund_policy": ("refund",),
        "mobile_login": ("mobile login",),
        "branch_onboarding": ("branch onboarding",),
    },
}
ENUM_RULES = {
    "urgency": (
        ("high", ("urgent", "regulatory", "escalation", "strict access controls", "will not trust")),
        ("medium", ("need", "blocker", "pilot", "review", "missing", "should not be buried")),
    ),
    "implementation_blocker": (
        ("regulatory_escalation", ("regulatory", "regulated", "escalation")),
        ("security_review", ("security review", "sso", "audit logs", "redaction", "access controls")),
        ("missing_data", ("missing", "duplicate account", "campaign names inconsistently", "transcripts are separate")),
        ("integration", ("integration", "bigquery", "warehouse", "slack", "jira", "salesforce")),
        ("stakeholder_alignment", ("leadership will not trust", "reviewers", "owner")),
    ),
    "renewal_risk": (
        ("pricing_pushback", ("pricing objection", "pricing blocked", "pricing")),
        ("low_adoption", ("adoption risk", "low adoption")),
        ("competitor_evaluation", ("competitor", "vendor comparison")),
        ("unresolved_blocker", ("blocker", "will not trust", "retention")),
    ),
}
BOOLEAN_RULES = {"security_review_requested": ("security", "sso", "audit", "redaction", "access control", "retention", "regulated")}
ACTION_TERMS = ("next step", "we will", "will add", "can start", "start with", "review", "please")
#: All values an enum may take, in catalog order.
ENUM_VALUES = {
    "urgency": (NOT_MENTIONED, "low", "medium", "high"),
    "implementation_blocker": (NOT_MENTIONED, "security_review", "missing_data", "integration", "stakeholder_alignment", "regulatory_escalation"),
    "renewal_risk": (NOT_MENTIONED, "pricing_pushback", "low_adoption", "unresolved_blocker", "competitor_evaluation"),
}
FIELD_ORDER = ("topic", "pain_point", "product_area", "urgency", "implementation_blocker", "renewal_risk", "integration_request", "security_review_requested", "data_gap", "complaint_theme", "next_action")


#: What each built-in field is for: description and use cases, which catalogs show and search texts match.
ABOUT = {
    "topic": ("Themes that a call is about", ("filter calls by theme", "count calls by theme")),
    "pain_point": ("Problems that a customer describes", ("rank problems", "find calls with a problem")),
    "product_area": ("Parts of a product that a call touches", ("count calls by product area",)),
    "urgency": ("How urgent a customer's need is", ("find urgent calls", "count calls by urgency")),
    "implementation_blocker": ("What keeps an implementation from going on", ("find blocked calls", "count blockers")),
    "renewal_risk": ("Why a renewal may fail", ("find calls at risk", "count risks")),
    "integration_request": ("Systems that a customer wants connected", ("count requested integrations",)),
    "security_review_requested": ("Whether a security review is asked for", ("find security reviews", "share of calls with a review")),
    "data_gap": ("Data that is missing or unreliable", ("find data gaps",)),
    "complaint_theme": ("What a complaint is about", ("count complaints by theme",)),
    "next_action": ("The next step that was agreed", ("list next steps",)),
}


def builtin_specs() -> list[FieldSpec]:
    out = []
    for name in FIELD_ORDER:
        about = dict(zip(("description", "downstream_use_cases"), ABOUT[name]))
        if name in LIST_RULES:
            out.append(FieldSpec(name, "list", allowed_values=tuple(LIST_RULES[name]), **about))
        elif name in ENUM_RULES:
            out.append(FieldSpec(name, "enum", allowed_values=ENUM_VALUES[name], **about))
        elif name in BOOLEAN_RULES:
            out.append(FieldSpec(name, "boolean", **about))
        else:
            out.append(FieldSpec(name, "string", facetable=False, aggregatable=False, **about))
    return out


def with_chunks(calls: DataFrame, chunks: DataFrame) -> DataFrame:
    """calls with ``chunks``: array of (chunk_index, chunk_id, low) in order."""
    item = F.struct("chunk_index", "chunk_id", F.lower("text").alias("low"))
    each = chunks.groupBy("call_id").agg(F.array_sort(F.collect_list(item)).alias("chunks"))
    return calls.join(each, "call_id", "left").withColumn("chunks", F.coalesce("chunks", F.array().cast("array<struct<chunk_index:int,chunk_id:string,low:string>>")))


def refs_for(terms: Sequence[str] | Column, limit: int = 3) -> Column:
    """Refs of the first ``limit`` chunks that hold any of the terms."""

    def has(c: Column) -> Column:
        if isinstance(terms, Column):
            return c["low"].contains(F.lower(terms))
        out = F.lit(False)
        for t in terms:
            out = out | c["low"].contains(t.lower())
        return out

    return F.transform(F.slice(F.filter("chunks", has), 1, limit), lambda c: F.concat(F.lit("chunk:"), c["chunk_id"]))


def _row(name: str, at: int, supported: Column, refs: Column, text: Column | None = None, items: Column | None = None, flag: Column | None = None, kind: str = "string") -> Column:
    none = lambda t: F.lit(None).cast(t)
    return F.struct(
        F.lit(name).alias("field_name"), F.lit(at).alias("field_ordinal"), F.lit(kind).alias("field_type"), (text if text is not None else none("string")).alias("value_str"), (items if items is not None else none("array<string>")).alias("value_list"),
        (flag if flag is not None else none("boolean")).alias("value_bool"), refs.alias("evidence_refs"), F.when(F.size(refs) > 0, "high").otherwise("low").alias("confidence"), (~supported).alias("abstained"),
    )


def list_row(name: str, at: int, rules: dict[str, Sequence[str]]) -> Column:
    """Values in rule order whose keywords occur in a chunk; two refs a value, four in all."""
    per = F.array(*[F.struct(F.lit(v).alias("v"), refs_for(ks, 2).alias("r")) for v, ks in rules.items()])
    hit = F.filter(per, lambda x: F.size(x["r"]) > 0)
    values = F.transform(hit, lambda x: x["v"])
    refs = F.slice(F.array_distinct(F.flatten(F.transform(hit, lambda x: x["r"]))), 1, 4)
    return _row(name, at, F.size(values) > 0, refs, items=values, kind="list")


def enum_row(name: str, at: int, rules: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The first rule that the whole transcript meets; its refs come from chunks, so there may be none."""
    value, refs = F.lit(NOT_MENTIONED), F.array().cast("array<string>")
    for v, terms in reversed(rules):
        hit = contains_any("transcript", list(terms))
        value, refs = F.when(hit, v).otherwise(value), F.when(hit, refs_for(terms)).otherwise(refs)
    return _row(name, at, value != NOT_MENTIONED, refs, text=value, kind="enum")


def boolean_row(name: str, at: int, terms: Sequence[str]) -> Column:
    refs = refs_for(terms)
    return _row(name, at, F.size(refs) > 0, refs, flag=F.size(refs) > 0, kind="boolean")


def action_row(name: str, at: int) -> Column:
    """The first turn with an action term; its ref is the first chunk with that turn's first 80 characters."""
    turn = F.get(F.filter("turns", lambda t: contains_any(t["text"], list(ACTION_TERMS))), F.lit(0))["text"]
    refs = F.when(turn.isNotNull(), refs_for(F.substring(turn, 1, 80), 1)).otherwise(F.array().cast("array<string>"))
    return _row(name, at, turn.isNotNull(), refs, text=F.coalesce(collapsed(turn), F.lit(NOT_MENTIONED)))


def refs_for_label(label: str, limit: int = 2) -> Column:
    """Refs of the first ``limit`` chunks that hold the label as a phrase, or all of its words of three letters or more."""
    phrase = label.replace("_", " ")
    words = [w for w in phrase.split() if len(w) > 2]

    def has(c: Column) -> Column:
        every = F.lit(bool(words))
        for w in words:
            every = every & c["low"].contains(w)
        return c["low"].contains(phrase) | every

    return F.transform(F.slice(F.filter("chunks", has), 1, limit), lambda c: F.concat(F.lit("chunk:"), c["chunk_id"]))


def generic_row(spec: FieldSpec, at: int) -> Column:
    """A row for a field that no built-in rule knows, by its name, type and allowed values; hits are of medium confidence."""
    if spec.name == "urgency":
        return enum_row(spec.name, at, ENUM_RULES["urgency"])
    if "action" in spec.name:
        return action_row(spec.name, at)
    none = F.array().cast("array<string>")
    if spec.type == "list" and spec.allowed_values:
        per = F.array(*[F.struct(F.lit(v).alias("v"), refs_for_label(v).alias("r")) for v in dict.fromkeys(spec.allowed_values)])
        hit = F.filter(per, lambda x: F.size(x["r"]) > 0)
        values, refs = F.transform(hit, lambda x: x["v"]), F.slice(F.array_distinct(F.flatten(F.transform(hit, lambda x: x["r"]))), 1, 4)
        row = _row(spec.name, at, F.size(values) > 0, refs, items=values, kind="list")
    elif spec.type == "list":
        row = _row(spec.name, at, F.lit(False), none, items=none, kind="list")
    elif spec.type == "enum":
        value, refs = F.lit(NOT_MENTIONED if NOT_MENTIONED in spec.allowed_values or not spec.allowed_values else spec.allowed_values[0]), none
        supported = F.lit(False)
        for v in reversed([v for v in spec.allowed_values if v != NOT_MENTIONED]):
            found = refs_for_label(v)
            value, refs, supported = F.when(F.size(found) > 0, v).otherwise(value), F.when(F.size(found) > 0, found).otherwise(refs), (F.size(found) > 0) | supported
        row = _row(spec.name, at, supported, refs, text=value, kind="enum")
    elif spec.type == "boolean":
        refs = refs_for_label(spec.name)
        row = _row(spec.name, at, F.size(refs) > 0, refs, flag=F.size(refs) > 0, kind="boolean")
    else:
        return _row(spec.name, at, F.lit(False), none, text=F.lit(NOT_MENTIONED))
    return row.withField("confidence", F.when(F.size(row["evidence_refs"]) > 0, "medium").otherwise("low"))


def rows_for(specs: Sequence[FieldSpec]) -> list[Column]:
    """Rules for any schema: the built-in ones where a built-in field's type and values are meant, else generic ones."""
    known = {s.name: s for s in builtin_specs()}
    built = dict(zip(FIELD_ORDER, builtin_rows()))
    same = lambda s: s.name in known and s.type == known[s.name].type and set(s.allowed_values) == set(known[s.name].allowed_values)
    return [built[s.name].withField("field_ordinal", F.lit(at)) if same(s) else generic_row(s, at) for at, s in enumerate(specs)]


def builtin_rows() -> list[Column]:
    rule = lambda at, name: list_row(name, at, LIST_RULES[name]) if name in LIST_RULES else enum_row(name, at, ENUM_RULES[name]) if name in ENUM_RULES else boolean_row(name, at, BOOLEAN_RULES[name]) if name in BOOLEAN_RULES else action_row(name, at)
    return [rule(at, name) for at, name in enumerate(FIELD_ORDER)]


def extract(calls: DataFrame, chunks: DataFrame, rows: list[Column] | None = None) -> DataFrame:
    """Long extractions, one row per (call, field). ``rows``: as built by the *_row functions or ``rows_for``; by default the built-in fields."""
    rows = builtin_rows() if rows is None else rows
    return with_chunks(calls, chunks).select("call_id", "ordinal", F.explode(F.array(*rows)).alias("x")).select("call_id", "ordinal", "x.*")


def whitelisted(refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(call_id, field_name, pos, ref) with ``known``: whether the ref names a chunk of that call. Others are what validation flags."""
    shown = chunks.select("call_id", F.concat(F.lit("chunk:"), "chunk_id").alias("ref")).distinct().withColumn("known", F.lit(True))
    return refs.join(shown, ["call_id", "ref"], "left").withColumn("known", F.coalesce("known", F.lit(False)))


def quality(extractions: DataFrame, total_calls: DataFrame) -> DataFrame:
    """Per field: support, fill rate over all calls, coverage over supported ones, and the gate on the unrounded coverage."""
    n = total_calls.agg(F.count(F.lit(1)).alias("n"))
    ok = ~F.col("abstained")
    out = extractions.groupBy("field_name").agg(F.count_if(ok).alias("support"), F.count_if(ok & (F.size("evidence_refs") > 0)).alias("with_refs")).crossJoin(F.broadcast(n))
    coverage = F.when(F.col("support") > 0, F.col("with_refs") / F.col("support")).otherwise(0.0)
    return out.select("field_name", F.col("support").alias("support_call_count"), F.round(F.try_divide("support", "n"), 4).alias("fill_rate"), F.round(coverage, 4).alias("evidence_coverage"), F.when((F.col("support") > 0) & (coverage >= LEAST_COVERAGE), "promote").otherwise("hold").alias("status"))


def pivot(calls: DataFrame, extractions: DataFrame, specs: list[FieldSpec]) -> DataFrame:
    """Silver rows: the envelope, one typed column per promoted field, evidence_refs and quality_flags. Of repeated
    extractions the last by ordinal of the extraction wins (``seq`` if there is such a column)."""
    seq = F.col("seq") if "seq" in extractions.columns else F.lit(0)
    wanted = extractions.where(F.col("field_name").isin([s.name for s in specs]))
    typed = {"list": "value_list", "boolean": "value_bool"}
    aggs = [F.max_by(F.when(F.col("field_name") == s.name, F.col(typed.get(s.type, "value_str"))), F.when(F.col("field_name") == s.name, seq)).alias(s.name) for s in specs]
    wrong = F.col("validation_errors") if "validation_errors" in extractions.columns else F.array().cast("array<string>")
    own = F.concat(F.coalesce(wrong, F.array().cast("array<string>")), F.when(~F.col("abstained") & (F.size("evidence_refs") == 0), F.array(F.lit("missing_evidence"))).otherwise(F.array().cast("array<string>")))
    has = [F.max_by(F.when(F.col("field_name") == s.name, own), F.when(F.col("field_name") == s.name, seq)).alias(f"_{s.name}") for s in specs]
    refs = F.map_from_entries(F.filter(F.collect_list(F.struct("field_name", "evidence_refs")), lambda e: F.size(e["evidence_refs"]) > 0)).alias("evidence_refs")
    wide = wanted.groupBy("call_id").agg(*aggs, *has, refs)
    told = lambda s: F.coalesce(F.transform(f"_{s.name}", lambda e: F.concat(F.lit(f"{s.name}:"), e)), F.array(F.lit(f"{s.name}:missing_extraction")))
    flags = F.concat(*[told(s) for s in specs]) if specs else F.array().cast("array<string>")
    keep = [c for c in calls.columns if c not in ("turns", "transcript", "metadata")]
    return calls.select(*keep).join(wide, "call_id", "left").select(*keep, *[s.name for s in specs], "evidence_refs", flags.alias("quality_flags"), F.lit(SCHEMA_VERSION).alias("schema_version"))


def catalog_of(specs: list[FieldSpec], report: DataFrame) -> Catalog:
    """The catalog of promoted fields: a report has one row per field, so it may be collected."""
    good = {r["field_name"] for r in report.where("status = 'promote'").select("field_name").collect()}
    return Catalog.of(*[s for s in specs if s.name in good])


def catalog_table(spark: SparkSession, specs: list[FieldSpec], report: DataFrame, feedback: DataFrame | None = None) -> DataFrame:
    """Specs left joined with their quality and, by name, with what feedback asks of them: one row per field with how it may be
    searched, where its evidence is and what it is good for."""
    rows = [(s.name, at, s.type, s.description, list(s.allowed_values), s.filterable, s.facetable, s.aggregatable, f"silver_calls.{s.name}", f"evidence_refs.{s.name}", list(s.downstream_use_cases)) for at, s in enumerate(specs)]
    kinds = "field_name string, field_ordinal int, type string, description string, allowed_values array<string>, filterable boolean, facetable boolean, aggregatable boolean, path string, evidence_path string, good_for array<string>"
    out = spark.createDataFrame(rows, kinds).join(report, "field_name", "left")
    if feedback is not None:
        out = out.join(feedback.select("field_name", F.col("priority").alias("requested_priority"), F.col("action").alias("requested_action"), F.col("count").alias("requests")), "field_name", "left")
    return out.orderBy("field_ordinal")
