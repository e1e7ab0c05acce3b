"""Structured Streaming: tail a folder of log rows into a key-value store, and windowed counts over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veltra.operators.kv import SCHEMA, KVStore
import veltra._ship  # noqa: F401


def log_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Rows of Parquet files of (user_key, seq, kind, value) as they arrive in a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def flush_into(stream: DataFrame, store: KVStore, checkpoint: str, once: bool = False, compact: bool = False) -> StreamingQuery:
    """Append each micro-batch to the store, and compact it when the picker says so. Rows up to the store's sequence number
    are left out, so a batch that runs again after a failure has no effect."""

    def flush(rows: DataFrame, _: int) -> None:
        store.append(rows)
        if compact:
            store.compact_if_due()

    writer = stream.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def counts(events: DataFrame, ts: str, window: str, delay: str, *keys: str) -> DataFrame:
    """Rows per window and keys; events later than delay are left out."""
    return events.withWatermark(ts, delay).groupBy(F.window(ts, window), *keys).agg(F.count(F.lit(1)).alias("n"))
