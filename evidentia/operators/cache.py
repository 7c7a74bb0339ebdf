"""The lookup cache: which queries a catalogue was asked again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TTL_MS = 30 * 24 * 3600 * 1000
#: The time of a lookup without one, after all others.
UNTIMED = 1 << 47


def probe(queries: DataFrame, cached: DataFrame, now: str, ttl_ms: int = TTL_MS) -> DataFrame:
    """Queries (query) with ``docs`` of the cache (query, docs, cached_at) where it has them and they aren't older than the limit."""
    fresh = cached.where(F.timestamp_diff("MILLISECOND", F.col("cached_at"), F.lit(now).cast("timestamp")) <= ttl_ms).select(F.col("query").alias("key"), "docs")
    return queries.withColumn("key", F.trim(F.lower("query"))).join(fresh, "key", "left").drop("key")


def store(cached: DataFrame, found: DataFrame, now: str) -> DataFrame:
    """The cache with the results ``found`` (query, docs) put in, times reset."""
    new = found.select(F.trim(F.lower("query")).alias("query"), "docs", F.lit(now).cast("timestamp").alias("cached_at"))
    return cached.join(new, "query", "left_anti").unionByName(new)


def _replay(ttl_ms: int):
    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (event_id, key, at_ms) in order of key and time. A lookup misses if the last miss is older than the limit; a hit doesn't make the entry younger.

        All keys of a batch go one miss ahead together; of the last key the last miss is kept for the next batch.
        """
        last = missed = None
        for batch in batches:
            if not len(batch):
                continue
            runs = pc.run_end_encode(batch["key"], run_end_type=pa.int32())
            ends = runs.run_ends.to_numpy()
            codes = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
            times = batch["at_ms"].to_numpy()
            low = int(times.min())
            # one ascending line of all keys' times, a key's stretch being longer than its times and the limit
            span = int(times.max()) - low + ttl_ms + 2
            line = codes * span + (times - low)
            at = np.concatenate([[0], ends[:-1]])
            if runs.values[0].as_py() == last:
                first = int(np.searchsorted(line, missed - low + ttl_ms, side="right"))
                at = np.concatenate([[first] if first < ends[0] else [], at[1:]]).astype(np.int64)
            hit = np.ones(len(times), bool)
            while len(at):
                hit[at] = False
                following = np.searchsorted(line, line[at] + ttl_ms, side="right")
                at = following[following < ends[codes[at]]]
            own = np.flatnonzero(~hit[int(ends[-2]) if len(ends) > 1 else 0 :])
            if len(own):
                missed = int(times[(int(ends[-2]) if len(ends) > 1 else 0) + own[-1]])
            last = runs.values[-1].as_py()
            yield pa.RecordBatch.from_arrays([batch["event_id"], batch["key"], pa.array(hit)], names=["event_id", "key", "hit"])

    return replay


def hits(lookups: DataFrame, ttl_ms: int = TTL_MS) -> DataFrame:
    """Lookups (event_id, key, ts) -> (event_id, key, hit), replayed in order of time for every key.

    The entry's age counts from the last miss, so a key's history is a fold: rows are dealt and sorted by key and time once and folded as they stream by.
    Lookups without a time come last.
    """
    at = F.coalesce(F.unix_millis(F.col("ts").cast("timestamp")), F.lit(UNTIMED))
    rows = lookups.select(F.col("event_id").cast("long").alias("event_id"), F.trim(F.lower("key")).alias("key"), at.alias("at_ms"))
    ordered = rows.repartition("key").sortWithinPartitions("key", "at_ms", "event_id")
    return ordered.mapInArrow(_replay(ttl_ms), "event_id long, key string, hit boolean")


def stateful_hits(ttl_ms: int = TTL_MS):
    """The same fold for a stream, keyed by ``key``: state is the time of the last miss. For ``applyInPandasWithState``."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        (missed,) = state.get if state.exists else (None,)
        rows = pd.concat(list(batches)).sort_values(["at_ms", "event_id"], kind="stable")
        out = []
        for event, at in zip(rows["event_id"], rows["at_ms"], strict=True):
            hit = missed is not None and at - missed <= ttl_ms
            if not hit:
                missed = int(at)
            out.append((event, key[0], hit))
        state.update((missed,))
        yield pd.DataFrame(out, columns=["event_id", "key", "hit"])

    return step
