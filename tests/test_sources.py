"""Replies of readers, injected readers and catalogues, ground truth and reports, stored tables, and streams."""

import datetime
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from evidentia.operators import cache, evaluate
from evidentia.operators import lines as L
from evidentia.sources import readings, reports, store
from evidentia.streaming import scans

GOOD = {"title": "Студија во скарлет", "author": "Артур Конан Дојл", "confidence": 92, "titleAlternates": ["Скарлет"], "authorAlternates": [], "rawText": "СТУДИЈА\nВО СКАРЛЕТ", "reason": "large type"}


def parsed(spark, *replies):
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "scan_id int, raw string")
    return readings.parse_readings(rows).orderBy("scan_id").collect()


def test_replies(spark):
    def reply(**changes):
        return json.dumps({**GOOD, **changes}, ensure_ascii=False)

    words = [reply(title=w) for w in ("null", "None", "n/a", "UNKNOWN", "unreadable", "   ")]
    bad = ["I could not read that cover.", "", '{"title": "Half a', '{"title": "Half a", }', None]
    rows = parsed(
        spark, reply(), f"```json\n{reply()}\n```", f"Here is the cover:\n{reply()}\nHope that helps.", reply(title=None, author=None, confidence=80), reply(confidence=0.85), reply(confidence=500), reply(confidence=-20), reply(confidence="lots"),
        reply(titleAlternates=["Студија во скарлет", "Скарлет", "СКАРЛЕТ", None, 5, " "]), reply(titleAlternates="Скарлет"), f"[{reply()}]", json.dumps({"title": 5, "author": ["x"]}), *words, *bad,
    )
    first = rows[0]
    assert (first.title, first.author, first.confidence, first.title_alternates, first.author_alternates, first.raw_text, first.reason, first.error) == (GOOD["title"], GOOD["author"], 92, ["Скарлет"], [], GOOD["rawText"], "large type", None)
    assert rows[1].title == GOOD["title"] and rows[2].author == GOOD["author"] and rows[10].title == GOOD["title"]
    assert (rows[3].title, rows[3].author, rows[3].confidence, rows[3].error) == (None, None, 0, None)
    assert [r.confidence for r in rows[4:8]] == [85, 100, 0, 0]
    assert rows[8].title_alternates == ["Скарлет"] and rows[9].title_alternates == []
    assert (rows[11].title, rows[11].author, rows[11].raw_text, rows[11].reason) == (None, None, "", readings.READ_BY_REMOTE)
    assert [r.title for r in rows[12 : 12 + len(words)]] == [None] * len(words)
    assert [(r.title, r.error) for r in rows[-len(bad) :]] == [(None, "malformed")] * len(bad)


def test_reply_text(spark):
    def payload(*parts):
        return json.dumps({"candidates": [{"content": {"parts": list(parts)}}]})

    texts = {payload({"text": "a"}, {"text": "b"}): "ab", payload({"text": " "}): None, payload({"x": 1}, {"text": 5}, {"text": "c"}): "c", '{"candidates": []}': None, "{}": None, "nonsense": None, '{"candidates": [{"content": null}]}': None}
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", readings.reply_text(F.col("t")).alias("x")).orderBy("i").collect()
    assert [r.x for r in rows] == list(texts.values())


def test_a_reading_becomes_evidence(spark):
    rows = spark.createDataFrame([(7, json.dumps({**GOOD, "confidence": 15, "titleAlternates": ["A", "B", "C"], "rawText": " one \r\n\n two"})), (8, "no")], "scan_id long, raw string")
    found = readings.detections_of(readings.parse_readings(rows))
    assert [(r.scan_id, r.title, r.source) for r in found.collect()] == [(7, GOOD["title"], "ai")]
    lines, ranked = readings.evidence_of(found)
    assert [(r.line_no, r.text, r.confidence, tuple(r.bbox)) for r in lines.collect()] == [(0, "one", 15.0, (0, 0, 0, 0)), (1, "two", 15.0, (0, 0, 0, 0))]
    assert [(r.rank, r.title, r.score, r.author_confidence) for r in ranked.orderBy("rank").collect()] == [(1, GOOD["title"], 0.15, 15.0), (2, "A", 0.0, 15.0), (3, "B", 0.0, 15.0)]


def test_trees(spark):
    def word(text, sure, height=10.0):
        return (text, sure, (0.0, 0.0, 5.0, height))

    box = (0.0, 0.0, 50.0, 40.0)
    tree = (None, [([([("THE  ROAD\n", 90.0, box, [word("THE", 80.0), word(" ", 1.0), word("ROAD", 100.0, 30.0)]), ("  ", 5.0, box, [])],), (None,)],), (None,)])
    rows = spark.createDataFrame([(1, 0, tree), (2, 0, None), (3, 1, ("given", []))], f"scan_id long, pass_no int, tree struct<{readings.TREE}>").withColumn("page_height", F.lit(100.0))
    found = readings.lines_of(rows).collect()
    assert [(r.scan_id, r.line_no, r.text, len(r.words), r.height, r.page_height) for r in found] == [(1, 0, "THE ROAD", 2, 30.0, 100.0)]
    assert {r.scan_id: (r.text, r.mean_confidence) for r in readings.texts_of(rows).collect()} == {1: ("THE ROAD", 90.0), 2: ("", 0.0), 3: ("given", 0.0)}
    assert L.mean_confidence(readings.lines_of(rows)).first().mean_confidence == 90.0


def test_injected_reader_and_catalogue(spark, tmp_path):
    for i in range(4):
        (tmp_path / f"{i}.jpg").write_bytes(bytes([i]))
    images = readings.photos(spark, str(tmp_path)).select("image_id", "path", "content")

    def reader(batch):
        if any(bytes(c) == b"\x02" for c in batch["content"]):
            raise ValueError("blurred")
        return pd.DataFrame({"image_id": batch["image_id"], "text": [f"read {bytes(c)[0]}" for c in batch["content"]]})

    found = readings.read_with(images, reader, "image_id long, text string, error string").collect()
    assert sorted((r.text or "", r.error or "") for r in found) == [("", "ValueError: blurred"), ("read 0", ""), ("read 1", ""), ("read 3", "")]

    def client(query, limit):
        if query == "down":
            raise OSError("no network")
        return [{"title": f"{query} {i}", "author_name": ["A"], "edition_count": i} for i in range(9)] if query != "none" else None

    queries = spark.createDataFrame([(1, 1, "dune"), (1, 2, "none"), (2, 1, "down")], "scan_id long, query_no int, query string")
    found = readings.search_with(queries, client, 3).orderBy("scan_id", "query_no", "place").collect()
    assert [(r.scan_id, r.query_no, r.place, r.title, r.error) for r in found] == [(1, 1, 1, "dune 0", None), (1, 1, 2, "dune 1", None), (1, 1, 3, "dune 2", None), (2, 1, None, None, "OSError: no network")]


def test_truth_and_reports(spark, tmp_path):
    (tmp_path / "truth.json").write_text(json.dumps([{"id": "a", "file": "a.png", "title": "Dune", "author": "Frank Herbert", "layout": "top"}, {"id": "b", "title": "", "author": "", "expect": "uncertain"}]))
    truth = reports.read_truth(spark, str(tmp_path / "truth.json"))
    got = spark.createDataFrame([("a", "DUNE", "F. Herbert", 90), ("b", "", "", 10)], "id string, title string, author string, confidence int")
    rows = evaluate.score_rows(truth.select("id", "title", "author", "expect"), got)
    reports.write_report(rows, evaluate.summary(rows, []), str(tmp_path / "report"))
    assert {r.id: (r.title_exact, r.title_fuzzy) for r in spark.read.json(str(tmp_path / "report/rows")).collect()} == {"a": (True, True), "b": (True, False)}
    table = [r.value for r in spark.read.text(str(tmp_path / "report/markdown")).collect()]
    assert table == ["| covers | title_exact | title_fuzzy | author_hit | confidently_wrong |", "|---|---|---|---|---|", "| 2 | 2 | 1 | 1 | 0 |"]


def test_benchmark_set(spark):
    wanted = spark.createDataFrame([("x", "dune"), ("y", "emma"), ("z", "none")], "id string, query string")
    found = spark.createDataFrame([("x", 1, "Dune", ["F"], 100), ("x", 2, "Dune", ["Frank"], 9000), ("x", 3, "Dune", ["G"], 90000), ("y", 1, None, ["A"], 9000), ("y", 2, "Emma", [], 9000), ("y", 3, "Emma", ["Jane"], 8000)], "id string, place int, title string, author_name array<string>, bytes long")
    assert sorted(map(tuple, reports.benchmark_set(wanted, found).collect())) == [("x", "Dune", "Frank", 9000), ("y", "Emma", "Jane", 8000)]


def test_store(spark, tmp_path):
    tables = store.Store(spark, f"file:{tmp_path}/tables")
    assert tables.read("books", "id string, title string").collect() == []
    tables.replace("books", spark.createDataFrame([("a", "Dune")], "id string, title string"))
    now = tables.read("books", "id string, title string")
    tables.replace("books", now.unionAll(spark.createDataFrame([("b", "Emma")], "id string, title string")))
    (tmp_path / "tables/books/9").mkdir()  # a version that was never finished
    assert sorted(map(tuple, tables.read("books", "id string, title string, status string").collect())) == [("a", "Dune", None), ("b", "Emma", None)]
    for i in range(3):
        tables.replace("books", spark.createDataFrame([(str(i), "x")], "id string, title string"))
    tables.prune("books")
    assert tables._versions("books") == [4, 5]
    assert tables.read("books", "id string, title string").first().id == "2"


def test_scans_on_a_stream(spark, tmp_path):
    lines = [{"scan_id": i, "pass_no": 0, "line_no": j, "text": t, "confidence": 90.0, "height": 50.0, "page_height": 900.0, "bbox": {"x0": 0, "y0": j * 300, "x1": 200, "y1": j * 300 + 50}} for i in range(3) for j, t in enumerate(["Iron Harvest", "Penguin Books"])]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/one.json").write_text("\n".join(map(json.dumps, lines[:4])))

    def run():
        query = scans.each_batch(scans.arriving(spark, str(tmp_path / "in")), L.usable_lines, str(tmp_path / "out"), str(tmp_path / "state"))
        query.awaitTermination(120)
        return sorted((r.scan_id, r.text) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [(0, "Iron Harvest"), (1, "Iron Harvest")]
    (tmp_path / "in/two.json").write_text("\n".join(map(json.dumps, lines[4:])))
    assert run() == [(0, "Iron Harvest"), (1, "Iron Harvest"), (2, "Iron Harvest")]


@pytest.mark.parametrize("cuts", [(4,), (1, 2, 5)])
def test_the_cache_on_a_stream_is_the_batch(spark, tmp_path, cuts):
    hour = 3600
    events = [(i, k, datetime.datetime.fromtimestamp(t * hour, datetime.UTC).replace(tzinfo=None)) for i, (k, t) in enumerate([("k", 0), ("z", 1), ("k", 10), (" K", 29), ("k", 31), ("z", 32), ("k", 60), ("k", 62)])]
    shape = "event_id long, key string, ts timestamp"
    folder = tmp_path / "in"
    folder.mkdir()
    stream = scans.cache_hits(spark.readStream.schema(shape).parquet(str(folder)), 30 * hour * 1000)
    for a, b in zip((0, *cuts), (*cuts, len(events)), strict=True):
        spark.createDataFrame(events[a:b], shape).coalesce(1).write.mode("append").parquet(str(folder))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    found = {r.event_id: r.hit for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == {r.event_id: r.hit for r in cache.hits(spark.createDataFrame(events, shape), 30 * hour * 1000).collect()}
    assert not found[0] and found[2] and not found[4]
