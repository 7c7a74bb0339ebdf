"""What is exploded is met by shuffles: Spark takes it for as large as before and would send it to every task, through the driver."""

from pyspark.sql import functions as F

from evidentia.llm import shared, simhash


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_anchors_are_never_sent_whole(spark):
    prints = spark.range(1000).select(F.xxhash64("id").alias("fp"))
    assert "Broadcast" not in _plan(simhash.links(prints))


def test_copies_for_cells_are_never_sent_whole(spark, monkeypatch):
    rows = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    assert "Broadcast" not in _plan(shared.with_least(rows, "k", "id", "least"))
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 3)
    table = spark.range(7).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    met = shared.joined_small(rows, table, ["k"])
    assert "Broadcast" not in _plan(met)
    assert met.where("v = 2 * k").count() == met.count() == 1000
