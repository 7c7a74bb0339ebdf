"""Operators that keep state on a stream: the lookup cache with expiring entries, and scans put together from lines of many batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from evidentia.operators.cache import TTL_MS

HIT = "event_id long, key string, hit boolean"


class ExpiringEntries(StatefulProcessor):
    """The time of a key's last miss, dropped by a timer as soon as no lookup can hit it any more.

    The timer runs on event time: once the watermark is past an entry's end, every later lookup of the key would miss anyway.
    """

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.missed = handle.getValueState("missed", "at_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows)).sort_values(["at_ms", "event_id"], kind="stable")
        missed = self.missed.get()[0] if self.missed.exists() else None
        before, out = missed, []
        for event, at in zip(found["event_id"], found["at_ms"], strict=True):
            hit = missed is not None and at - missed <= self.ttl_ms
            if not hit:
                missed = int(at)
            out.append((int(event), key[0], hit))
        if missed != before:
            if before is not None:
                self.handle.deleteTimer(before + self.ttl_ms + 1)
            self.missed.update((missed,))
            self.handle.registerTimer(missed + self.ttl_ms + 1)
        yield pd.DataFrame(out, columns=["event_id", "key", "hit"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.missed.exists() and self.missed.get()[0] + self.ttl_ms < expiredTimerInfo.getExpiryTimeInMs():
            self.missed.clear()
        yield pd.DataFrame([], columns=["event_id", "key", "hit"])

    def close(self) -> None:
        pass


def expiring_hits(lookups: DataFrame, ttl_ms: int = TTL_MS, late: str = "10 minutes") -> DataFrame:
    """A stream of lookups (event_id, key, ts) -> (event_id, key, hit), as ``cache.hits`` gives for all of them at once.

    Lookups come in order of time from batch to batch, but for being ``late``; what is later still is lost; state is kept for keys looked up within the limit of the watermark.
    """
    rows = lookups.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = rows.select("event_id", F.trim(F.lower("key")).alias("key"), F.unix_millis("ts").alias("at_ms"), "ts")
    return rows.groupBy("key").transformWithStateInPandas(ExpiringEntries(ttl_ms), HIT, "Append", "EventTime")


LINES = "scan_id long, n_lines int, complete boolean, lines string"


class ScanLines(StatefulProcessor):
    """The lines of a scan so far, until its last pass has come whole or nothing has come for too long."""

    def __init__(self, timeout_ms: int) -> None:
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lines = handle.getMapState("lines", "pass_no int, line_no int", "line string")
        self.wanted = handle.getValueState("wanted", "n long, until_ms long")

    def _given(self, key, complete: bool) -> pd.DataFrame:
        rows = sorted((int(k[0]), int(k[1]), v[0]) for k, v in self.lines.iterator())
        self.lines.clear()
        self.wanted.clear()
        return pd.DataFrame([(key[0], len(rows), complete, "[" + ",".join(x for _, _, x in rows) + "]")], columns=["scan_id", "n_lines", "complete", "lines"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        wanted, until = self.wanted.get() if self.wanted.exists() else (None, None)
        latest = until
        for batch in rows:
            for number, line, text, total, at in zip(batch["pass_no"], batch["line_no"], batch["line"], batch["total_lines"], batch["at_ms"], strict=True):
                self.lines.updateValue((int(number), int(line)), (text,))
                wanted = int(total) if pd.notna(total) else wanted
                latest = max(latest or 0, int(at) + self.timeout_ms)
        if wanted is not None and sum(1 for _ in self.lines.keys()) >= wanted:
            if until is not None:
                self.handle.deleteTimer(until)
            yield self._given(key, True)
            return
        if latest != until:
            if until is not None:
                self.handle.deleteTimer(until)
            self.handle.registerTimer(latest)
        self.wanted.update((wanted, latest))
        yield pd.DataFrame([], columns=["scan_id", "n_lines", "complete", "lines"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._given(key, False) if self.wanted.exists() else pd.DataFrame([], columns=["scan_id", "n_lines", "complete", "lines"])

    def close(self) -> None:
        pass


def assembled(lines: DataFrame, shape: str, timeout_ms: int, late: str = "10 minutes") -> DataFrame:
    """A stream of lines (scan_id, pass_no, line_no, total_lines, ts, ...) -> a row per scan (scan_id, n_lines, complete, lines) once it is whole.

    ``total_lines`` is how many lines the scan has in all, which some line of it tells; ``lines`` is an array of ``shape``, in order of pass and line. Lines may
    come in any batches; a line that comes again replaces itself. A scan of which nothing came for ``timeout_ms`` is given as far as it came.
    """
    names = [x.split()[0] for x in shape.split(", ")]
    rows = lines.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = rows.select("scan_id", "pass_no", "line_no", F.to_json(F.struct(*names)).alias("line"), "total_lines", F.unix_millis("ts").alias("at_ms"), "ts")
    found = rows.groupBy("scan_id").transformWithStateInPandas(ScanLines(timeout_ms), LINES, "Append", "EventTime")
    return found.withColumn("lines", F.from_json("lines", f"array<struct<{', '.join(f'{n}: {t}' for n, t in (x.split(' ', 1) for x in shape.split(', ')))}>>"))

