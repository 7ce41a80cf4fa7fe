"""Call records from JSONL, CSV and Parquet, schema on read, and from the driver's ``conversations``.

Every call keeps ``ordinal``, its place in the input: many results depend on order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names under which each part of a call may come, in order of preference.
CALL_ID = ("call_id", "calllog_id", "id", "source_record_id")
CUSTOMER = ("customer_id", "client_id", "account_id", "company_id")
ACCOUNT = ("account_name", "contact_detail", "company_name", "customer_name")
DATE = ("date", "call_event_date", "call_date", "started_at", "finished_at_jst", "created_at")
TRANSCRIPT = ("transcript", "text", "body", "best_text", "transcription")
TURNS = "calllog_result"


def first_present(columns: list[str], names: tuple[str, ...]) -> Column:
    """The first of ``names`` that is neither null nor empty; 0 and false count as present."""
    have = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def numbered(raw: DataFrame) -> DataFrame:
    """``raw``, read from files, with ``source_file``, ``line`` (from 1, within its file) and ``ordinal`` (over all files, by path). Ids that Spark gives out rise
    within each block of a file as it is read; blocks are counted, and what stands before each is added. No row is shuffled."""
    at = raw.withColumns({"source_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_id": F.monotonically_increasing_id()})
    blocks = at.groupBy("source_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("source_file", "_block", "_first", before(Window.partitionBy("source_file").orderBy("_block")).alias("_in_file"), before(Window.orderBy("source_file", "_block")).alias("_in_all"))
    place = F.col("_id") - F.col("_first")
    out = at.join(blocks, ["source_file", "_block"]).withColumn("line", place + F.col("_in_file") + 1).withColumn("ordinal", place + F.col("_in_all"))
    return out.drop("_block", "_id", "_first", "_in_file", "_in_all")


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """Reads and normalises calls; the suffix decides the format. Every record knows its place as ``path:line``: lines of JSONL with blank ones
    counted, rows of CSV after the header (a quoted cell may hold line breaks), rows of Parquet."""
    if path.endswith((".jsonl", ".json")):
        schema = spark.read.option("mode", "FAILFAST").json(path).schema
        rows = numbered(spark.read.text(path)).where(F.trim("value") != "")
        raw = rows.withColumn("_r", F.from_json("value", schema, {"mode": "FAILFAST"})).select("_r.*", F.col("source_file").alias("_file"), F.col("line").alias("_line"), F.col("ordinal").alias("_ordinal"))
    elif path.endswith(".csv"):
        raw = numbered(spark.read.option("header", True).option("mode", "FAILFAST").option("multiLine", True).option("escape", '"').csv(path))
        raw = raw.withColumnsRenamed({"source_file": "_file", "ordinal": "_ordinal"}).withColumn("_line", F.col("line") + 1).drop("line")
    elif path.endswith(".parquet"):
        raw = numbered(spark.read.parquet(path)).withColumnsRenamed({"source_file": "_file", "ordinal": "_ordinal", "line": "_line"})
    else:
        raise ValueError(f"format not known: {path}")
    at = F.concat("_file", F.lit(":"), F.col("_line").cast("string"))
    return normalize_calls(raw.withColumn("ordinal", F.col("_ordinal")).withColumn("source_path", at).drop("_file", "_line", "_ordinal"))


_ITEM = "struct<speaker:string,best_text:string,text:string,transcript:string>"


def turns_of(df: DataFrame, column: str = TURNS) -> Column:
    """Turns (turn_index from 1 over all items, speaker, text); items without text keep their number and go.

    The column may hold an array of structs or strings, or a string: JSON of a list or of one item, or plain text."""
    kind = df.schema[column].dataType
    c = F.col(column)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        names = kind.elementType.names
        pick = lambda x, ks: F.coalesce(*[F.nullif(x[k].cast("string"), F.lit("")) for k in ks if k in names], F.lit(""))
        items = F.transform(c, lambda x, i: F.struct((i + 1).alias("turn_index"), (F.coalesce(F.nullif(x["speaker"].cast("string"), F.lit("")), F.lit("unknown")) if "speaker" in names else F.lit("unknown")).alias("speaker"), F.trim(pick(x, ("best_text", "text", "transcript"))).alias("text")))
    elif isinstance(kind, T.ArrayType):
        items = F.transform(c.cast("array<string>"), lambda x, i: F.struct((i + 1).alias("turn_index"), F.lit("unknown").alias("speaker"), F.trim(F.coalesce(x, F.lit(""))).alias("text")))
    else:
        s = c.cast("string")
        # items are read as texts first: a list may mix objects, strings and numbers
        parsed = F.when(s.rlike(r"^\s*[\[{]"), F.from_json(F.when(s.rlike(r"^\s*\["), s).otherwise(F.concat(F.lit("["), s, F.lit("]"))), "array<string>"))
        as_item = lambda x: F.coalesce(F.when(x.rlike(r"^\s*\{"), F.from_json(x, _ITEM)), F.struct(F.lit("unknown").alias("speaker"), x.alias("best_text"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("transcript")))
        as_list = F.transform(parsed, as_item)
        plain = F.array(F.struct(F.lit("unknown").alias("speaker"), s.alias("best_text"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("transcript")))
        text = lambda x: F.trim(F.coalesce(F.nullif(x["best_text"], F.lit("")), F.nullif(x["text"], F.lit("")), x["transcript"], F.lit("")))
        items = F.transform(F.coalesce(as_list, F.when(s.isNotNull() & (s != ""), plain)), lambda x, i: F.struct((i + 1).alias("turn_index"), F.coalesce(F.nullif(x["speaker"], F.lit("")), F.lit("unknown")).alias("speaker"), text(x).alias("text")))
    return F.coalesce(F.filter(items, lambda x: x["text"] != ""), F.array().cast("array<struct<turn_index:int,speaker:string,text:string>>"))


def lines_as_turns(transcript: Column) -> Column:
    """Turns of a plain transcript: its lines that aren't blank."""
    lines = F.filter(F.transform(F.split(transcript, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(lines, lambda x, i: F.struct((i + 1).alias("turn_index"), F.lit("unknown").alias("speaker"), x.alias("text")))


def _metadata(raw: DataFrame, call_id: Column) -> Column:
    """map: the record's own metadata (a struct, a map, a JSON object in a string, else kept as ``raw_metadata``), then where the record comes from, then all
    its other columns. Earlier keys win, but for source_path."""
    scalar = lambda c: not isinstance(raw.schema[c].dataType, (T.ArrayType, T.StructType, T.MapType))
    none = F.create_map().cast("map<string,string>")
    own = none
    if "metadata" in raw.columns:
        kind = raw.schema["metadata"].dataType
        if isinstance(kind, (T.StructType, T.MapType)):
            own = F.coalesce(F.from_json(F.to_json("metadata"), "map<string,string>"), none)
        else:
            said = F.col("metadata").cast("string")
            own = F.when(said.isNull() | (F.trim(said) == ""), none).otherwise(F.coalesce(F.when(said.rlike(r"^\s*\{"), F.from_json(said, "map<string,string>")), F.create_map(F.lit("raw_metadata"), said)))
    rest = [c for c in raw.columns if c not in (TURNS, "metadata", "ordinal", "source_path")]
    told = [x for c in rest for x in (F.lit(c), F.col(c).cast("string") if scalar(c) else F.to_json(c))]
    others = F.map_filter(F.create_map(*told), lambda k, v: v.isNotNull()) if rest else none
    origin = F.create_map(F.lit("source_index"), F.lit("call_records"), F.lit("source_record_id"), call_id)
    path = F.create_map(F.lit("source_path"), F.col("source_path").cast("string")) if "source_path" in raw.columns else none
    both = F.map_filter(own, lambda k, v: k != "source_path") if "source_path" in raw.columns else own
    added = lambda have, more: F.map_concat(have, F.map_filter(more, lambda k, v: ~F.map_contains_key(have, k)))
    return added(added(added(both, path), origin), others)


def normalize_calls(raw: DataFrame) -> DataFrame:
    """(ordinal, call_id, customer_id, account_name, date, transcript, turns, metadata). A call without turns
    or transcript is an error. A call without an id is named by its place (``source_path``), else by a digest of its transcript."""
    cols = raw.columns
    unknown = lambda names: F.coalesce(first_present(cols, names), F.lit("unknown"))
    turns = turns_of(raw) if TURNS in cols else F.array().cast("array<struct<turn_index:int,speaker:string,text:string>>")
    said = F.array_join(F.transform("_turns", lambda t: F.concat(F.lit("turn:"), t["turn_index"].cast("string"), F.lit(" speaker:"), t["speaker"], F.lit(": "), t["text"])), "\n")
    plain = F.trim(first_present(cols, TRANSCRIPT))
    transcript = F.coalesce(F.when(F.size("_turns") > 0, said), F.nullif(plain, F.lit("")), F.raise_error(F.lit("a call has no transcript")).cast("string"))
    base = raw.withColumn("_turns", turns).withColumn("_said", transcript)
    named = [F.col("source_path")] if "source_path" in cols else []
    call_id = F.coalesce(first_present([c for c in cols], CALL_ID), *named, F.concat(F.lit("call-"), F.substring(F.sha2("_said", 256), 1, 12)))
    return base.select(
        "ordinal", call_id.alias("call_id"), unknown(CUSTOMER).alias("customer_id"), unknown(ACCOUNT).alias("account_name"), unknown(DATE).alias("date"), F.col("_said").alias("transcript"),
        F.when(F.size("_turns") > 0, F.col("_turns")).otherwise(lines_as_turns(F.col("_said"))).alias("turns"), _metadata(raw, call_id).alias("metadata"),
    )


def turns_table(conversations: DataFrame) -> DataFrame:
    """(call_id, ordinal, turn_index from 1, speaker, text) from (conv_id, turn, role, text)."""
    return conversations.select(F.col("conv_id").cast("string").alias("call_id"), F.col("conv_id").alias("ordinal"), (F.col("turn") + 1).cast("int").alias("turn_index"), F.coalesce(F.col("role"), F.lit("unknown")).alias("speaker"), F.coalesce(F.trim("text"), F.lit("")).alias("text")).where("text <> ''")


def gathered(turns: DataFrame) -> DataFrame:
    """One row per call with its turns in order. A call is a row by contract: its turns are bounded by what a call is."""
    t = F.struct("turn_index", "speaker", "text")
    return turns.groupBy("call_id", "ordinal").agg(F.array_sort(F.collect_list(t)).alias("turns"))
