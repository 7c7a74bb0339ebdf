"""State on streams: expiring entries of the lookup cache, and scans put together from lines of many batches."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.operators import cache
from evidentia.streaming import state

HOUR = 3600
LINE = "scan_id long, pass_no int, line_no int, text string, total_lines long, ts timestamp"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(key, before)


def at(hours):
    return datetime.datetime.fromtimestamp((1000 + hours) * HOUR, datetime.UTC).replace(tzinfo=None)


def fed(spark, folder, rows, shape, cuts, transform):
    """What a stream makes of rows that come in batches cut at ``cuts``, each run to its end, and the rows of state after each."""
    (folder / "in").mkdir()
    stream = transform(spark.readStream.schema(shape).parquet(str(folder / "in")))
    kept = []
    for a, b in zip((0, *cuts), (*cuts, len(rows)), strict=True):
        spark.createDataFrame(rows[a:b], shape).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        query = stream.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "state")).trigger(availableNow=True).start()
        query.awaitTermination(180)
        assert query.exception() is None
        kept.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    return spark.read.parquet(str(folder / "out")).collect(), kept


EVENTS = [("k", 0), ("z", 1), ("k", 10), (" K", 29), ("k", 31), ("z", 32), ("k", 60), ("k", 62), *((f"once{i}", 70 + i) for i in range(20)), ("k", 130), ("z", 131)]


@pytest.mark.parametrize("cuts", [(), (4,), (1, 2, 5, 9, 20, 29)])
def test_expiring_entries_are_the_batch(rocks, tmp_path, cuts):
    shape = "event_id long, key string, ts timestamp"
    rows = [(i, k, at(t)) for i, (k, t) in enumerate(EVENTS)]
    found, kept = fed(rocks, tmp_path, rows, shape, cuts, lambda s: state.expiring_hits(s, 30 * HOUR * 1000))
    wanted = {r.event_id: r.hit for r in cache.hits(rocks.createDataFrame(rows, shape), 30 * HOUR * 1000).collect()}
    assert {r.event_id: r.hit for r in found} == wanted and len(found) == len(rows)
    if len(cuts) > 2:
        # entries that nothing can hit any more are gone: the twenty keys asked for once don't stay
        assert max(kept) >= 8 and kept[-1] < max(kept)


@pytest.mark.parametrize("seed", [1, 2])
def test_scans_are_put_together_over_batches(rocks, tmp_path, seed):
    lines = [(s, n % 2, n, f"line {n} of {s}", 2 + s if n == s else None, at(1 + n / 60)) for s in range(6) for n in range(2 + s)]
    lines += [(90, 0, 0, "alone", 5, at(1)), (91, 0, 3, "no total", None, at(1.1))]
    order = np.random.default_rng(seed).permutation(len(lines))
    rows = [lines[i] for i in order]
    rows = [*rows, rows[0], (99, 0, 0, "much later", 1, at(60)), (98, 0, 0, "later still", 1, at(61)), (97, 0, 0, "last", 1, at(62))]
    cuts = (5, 11, 19, len(rows) - 3, len(rows) - 2, len(rows) - 1)
    found, kept = fed(rocks, tmp_path, rows, LINE, cuts, lambda s: state.assembled(s, "text string, total_lines long", 10 * HOUR * 1000, "5 hours"))
    whole = {r.scan_id: [x.text for x in r.lines] for r in found if r.complete}
    wanted = {s: [t for _, _, t in sorted((p, n, t) for i, p, n, t, _, _ in lines if i == s)] for s in range(6)}
    again = rows[0][0]
    assert {s: x for s, x in whole.items() if s < 90} == wanted
    assert {r.scan_id: [x.text for x in r.lines] for r in found if not r.complete and r.scan_id != again} == {90: ["alone"], 91: ["no total"]}
    assert kept[-1] < max(kept)


def test_complete_scans_keep_no_state(rocks, tmp_path):
    rows = [(s, 0, n, "x", 2, at(1)) for n in range(2) for s in range(30)]
    found, kept = fed(rocks, tmp_path, rows, LINE, (30,), lambda s: state.assembled(s, "text string", HOUR * 1000).select("scan_id", F.size("lines").alias("n")))
    assert sorted(r.scan_id for r in found) == list(range(30)) and all(r.n == 2 for r in found)
    assert kept[0] >= 30 and kept[-1] == 0
