"""Greedy packing of turns into chunks: a fold inside the row, then an explode. No shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import format_turn, snippet

MAX_CHARS = 900


def chunk_starts(turns: Column, max_chars: int = MAX_CHARS) -> Column:
    """The place (from 1) of each chunk's first turn. A turn that would carry a chunk that isn't empty over
    ``max_chars`` opens the next; a turn alone may be longer. Only turn texts count. The fold keeps no more than these places, and copies
    them only where a chunk opens."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("chars"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        n, at = F.length(t["text"]), acc["at"] + 1
        opens = (acc["at"] == 0) | (acc["chars"] + n > max_chars)
        return F.struct(at.alias("at"), F.when(opens, n).otherwise(acc["chars"] + n).alias("chars"), F.when(opens, F.concat(acc["out"], F.array(at))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(turns, start, step, lambda acc: acc["out"])


def pack(calls: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """calls (call_id, ordinal, turns) -> chunks (chunk_id, call_id, ordinal, chunk_index, turn_start, turn_end,
    speaker_set, text, snippet, char_count)."""
    begun = calls.where(F.size("turns") > 0).select("call_id", "ordinal", "turns", chunk_starts(F.col("turns"), max_chars).alias("starts"))
    end = lambda i: F.coalesce(F.get("starts", i + 1), F.size("turns") + 1)
    sliced = F.transform("starts", lambda s, i: F.slice("turns", s, end(i) - s))
    own = begun.select("call_id", "ordinal", F.posexplode(sliced).alias("chunk_index", "t")).withColumn("chunk_index", F.col("chunk_index") + 1)
    text = F.array_join(F.transform("t", lambda x: format_turn(x["turn_index"], x["speaker"], x["text"])), "\n")
    out = own.withColumn("text", text)
    return out.select(
        F.format_string("%s:chunk-%03d", "call_id", "chunk_index").alias("chunk_id"), "call_id", "ordinal", "chunk_index", F.array_min(F.transform("t", lambda x: x["turn_index"])).alias("turn_start"), F.array_max(F.transform("t", lambda x: x["turn_index"])).alias("turn_end"),
        F.array_sort(F.array_distinct(F.transform("t", lambda x: x["speaker"]))).alias("speaker_set"), "text", snippet("text").alias("snippet"), F.length("text").alias("char_count"),
    )
