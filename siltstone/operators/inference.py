"""Counts that a schema is inferred from: labels, bigrams, named systems, trigger sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import content_tokens, normalize_label
from siltstone.schemas import FieldSpec

# Words that open a kind of sentence, and systems known by name.
NEED_TERMS = ("need", "want", "would", "use", "ask", "asked", "care", "compare", "identify", "detect")
RISK_TERMS = ("blocker", "risk", "issue", "missing", "strict", "regulated", "objection", "duplicate", "trust", "avoid")
OUTPUT_TERMS = ("dashboard", "report", "archive", "search", "evidence", "summary", "workflow", "draft", "snippets")
SYSTEM_HINTS = ("api", "bigquery", "crm", "hubspot", "jira", "salesforce", "slack", "warehouse")


def label_counts(chunks: DataFrame, order: str = "ordinal", text: str = "text") -> DataFrame:
    """(label, count, first_row, first_pos) of tokens and adjacent pairs."""
    t = chunks.select(F.col(order).alias("o"), content_tokens(text).alias("t"))
    pairs = F.zip_with("t", F.slice("t", 2, 2147483646), lambda a, b: F.concat_ws("_", a, b))
    both = F.concat(F.col("t"), F.slice(pairs, F.lit(1), F.greatest(F.size("t") - 1, F.lit(0))))
    each = t.select("o", F.posexplode(both).alias("p", "label"))
    return each.groupBy("label").agg(F.count(F.lit(1)).alias("count"), F.min(F.struct("o", "p")).alias("f")).select("label", "count", F.col("f.o").alias("first_row"), F.col("f.p").alias("first_pos"))


def top_labels(chunks: DataFrame, most: int = 10, **where) -> DataFrame:
    return label_counts(chunks, **where).orderBy(F.desc("count"), "first_row", "first_pos").limit(most)


def system_mentions(chunks: DataFrame, text: str = "text") -> DataFrame:
    """Capitalised words count one, hinted systems two more each."""
    names = F.transform(F.regexp_extract_all(F.col(text), F.lit(r"\b[A-Z][A-Za-z0-9]{2,}\b"), F.lit(0)), lambda w: F.struct(normalize_label(w).alias("label"), F.lit(1).alias("w")))
    hints = F.transform(F.filter(content_tokens(text), lambda w: w.isin(*SYSTEM_HINTS)), lambda w: F.struct(w.alias("label"), F.lit(2).alias("w")))
    return chunks.select(F.explode(F.concat(names, hints)).alias("x")).groupBy("x.label").agg(F.sum("x.w").cast("long").alias("score"))


def sentence_labels(chunks: DataFrame, terms: tuple[str, ...] = NEED_TERMS, text: str = "text") -> DataFrame:
    """Of sentences with a trigger word: the phrase of the first three content tokens, and each of the first five."""
    s = chunks.select(F.explode(F.split(text, r"[\n.!?。]+")).alias("s")).where(F.arrays_overlap(F.regexp_extract_all(F.lower("s"), F.lit("[a-z0-9_]+"), F.lit(0)), F.array(*map(F.lit, terms))))
    t = s.select(content_tokens("s").alias("t")).where(F.size("t") > 0)
    labels = F.concat(F.array(F.concat_ws("_", F.slice("t", 1, 3))), F.slice("t", 1, 5))
    return t.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("count"))


def infer(chunks: DataFrame, most_values: int = 10, most_fields: int = 10) -> list[FieldSpec]:
    """Heuristic schema: list fields with their commonest labels (at most ``most_values`` each leave the cluster)."""
    first = lambda df, c: [r[0] for r in df.orderBy(F.desc(c), "label").limit(most_values).select("label").collect()]
    found = {
        "topic": [r[0] for r in top_labels(chunks, most_values).select("label").collect()],
        "need": first(sentence_labels(chunks, NEED_TERMS), "count"),
        "risk_signal": first(sentence_labels(chunks, RISK_TERMS), "count"),
        "requested_output": first(sentence_labels(chunks, OUTPUT_TERMS), "count"),
        "mentioned_system": first(system_mentions(chunks), "score"),
    }
    specs = [FieldSpec(k, "list", allowed_values=tuple(v)) for k, v in found.items() if v]
    return [*specs, FieldSpec("urgency", "enum", allowed_values=("not_mentioned", "medium", "high")), FieldSpec("next_action", "string", aggregatable=False)][:most_fields]
