"""Streaming ingest and streaming analytics (I6, I7, and extensions of A9-A13)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.analytics import average_ms
from lodestone.operators.index import clean_documents
from lodestone.sources.store import IndexStore


def stream_into_index(documents: DataFrame, store: IndexStore, checkpoint: str, order: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Upsert every micro-batch as one segment. Within a batch the row with the
    largest ``order`` wins, across batches the later one; invalid rows are dropped.
    A batch that is replayed after a failure replaces its own rows, so the result is
    the same as if it had run once."""

    def apply(batch: DataFrame, _: int) -> None:
        valid, _rejected = clean_documents(batch)
        store.upsert(valid, order)

    return documents.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_searches(events: DataFrame, window: str = "1 hour", slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Searches and mean response time per index, type and window; state older than
    the watermark is dropped."""
    frame = F.window("timestamp", window, slide) if slide else F.window("timestamp", window)
    grouped = events.withWatermark("timestamp", lateness).groupBy(frame.alias("window"), "index_name", "search_type")
    return grouped.agg(F.count(F.lit(1)).alias("searches"), average_ms().alias("avg_ms")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "index_name", "search_type", "searches", "avg_ms")
