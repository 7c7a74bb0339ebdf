"""Scans as they arrive, and the lookup cache with its state kept on a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evidentia.operators.cache import TTL_MS, stateful_hits

LINE = (
    "scan_id long, pass_no int, line_no int, text string, confidence double, height double, page_height double, bbox struct<x0: double, y0: double, x1: double, y1: double>"
)


def arriving(spark: SparkSession, folder: str, shape: str = LINE, files_a_batch: int = 100) -> DataFrame:
    """A stream of the JSON files that are put in a folder."""
    return spark.readStream.schema(shape).option("maxFilesPerTrigger", files_a_batch).json(folder)


def each_batch(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Write what a batch transform makes of every batch of a stream to ``out``, a folder per batch, until nothing more is there.

    A batch that is run again after a failure replaces its own folder, so rows are written once. A scan's lines must come in one batch.
    """

    def step(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cache_hits(lookups: DataFrame, ttl_ms: int = TTL_MS) -> DataFrame:
    """A stream of lookups (event_id, key, ts) -> (event_id, key, hit), the time of each key's last miss being the state.

    Lookups of one key must come in order of time from batch to batch; inside a batch they are put in order.
    """
    rows = lookups.select("event_id", F.trim(F.lower("key")).alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    return rows.groupBy("key").applyInPandasWithState(stateful_hits(ttl_ms), "event_id long, key string, hit boolean", "missed long", "append", "NoTimeout")
