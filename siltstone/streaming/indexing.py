"""Incremental indexing: micro-batches of chunks become segments of a search index, each exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from siltstone.operators.retrieval import search_documents
from siltstone.operators.search_index import SearchIndex

#: So many segments are merged into one.
MOST_SEGMENTS = 16


def index_batch(index: SearchIndex, batch: DataFrame, batch_id: int, text: str = "bm25_text", most_segments: int = MOST_SEGMENTS) -> None:
    """One batch as the segment of its number. The ledger is written last, so a batch that is run again after a failure is written anew, and one that was committed changes
    nothing, whatever it holds this time; ids that earlier batches brought are left out. Statistics and document frequencies are sums over committed segments."""
    batch.persist()
    try:
        index.add_new(batch, f"batch-{batch_id:012d}", text)
    finally:
        batch.unpersist()
    if len(index.segments()) >= most_segments:
        index.compact(f"merged-{batch_id:012d}")


def start(chunks: DataFrame, index: SearchIndex, checkpoint: str, most_segments: int = MOST_SEGMENTS) -> StreamingQuery:
    """Indexes a stream of chunks (chunk_id, call_id, text) until its source is drained."""
    return search_documents(chunks).writeStream.foreachBatch(lambda batch, k: index_batch(index, batch, k, most_segments=most_segments)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
