"""Incremental ingest: call records arriving as files become chunks, each call once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.operators.chunking import MAX_CHARS, pack

CALL = "call_id string, ordinal long, ts timestamp, turns array<struct<turn_index:int,speaker:string,text:string>>"


def read_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(CALL).option("maxFilesPerTrigger", max_files).json(path)


def once(calls: DataFrame, late: str = "1 day") -> DataFrame:
    """Repeated deliveries of a call within the watermark go; state is bounded by it."""
    return calls.withWatermark("ts", late).dropDuplicatesWithinWatermark(["call_id"])


def chunks_of(calls: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """Packing is a fold within the row, so it runs in a stream as it does in a batch."""
    return pack(calls, max_chars)


def start(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Appends the chunks of new calls to a Parquet folder, exactly once, and ends when the source is drained."""
    return chunks_of(once(read_stream(spark, source))).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_cohorts(calls: DataFrame, late: str = "1 day") -> DataFrame:
    return calls.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("count")).select(F.date_format("w.start", "yyyy-MM-dd").alias("key"), "count")
