"""The mix: every step in SQL, and the rates against a convex programme solved apart."""

import math

import numpy as np
from pyspark.sql import functions as F

from evidentia.llm import mixing, queries, shared


def test_multiplier_solves_the_dual(spark):
    rng = np.random.default_rng(3)
    for target_share in (0.05, 0.4, 1.0, 1.6, 1.95):
        sizes = rng.integers(1, 3000, 40).astype(float)
        words = sizes * rng.integers(1, 5, 40)
        scale, target = float((words * sizes).sum() / words.sum()), float(target_share * words.sum())
        low, high = -1e3, 1e3
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if (words * np.minimum(2, np.exp(np.minimum(700, middle * sizes / scale)))).sum() < target else (low, middle)
        rows = spark.createDataFrame([(list(zip((sizes / scale).tolist(), words.tolist(), strict=True)), target)], "sizes array<struct<x: double, words: double>>, target double")
        found = rows.select(mixing.multiplier(F.col("sizes"), F.col("target")).alias("m")).first().m
        assert math.isclose(found, low, rel_tol=1e-9, abs_tol=1e-9)
        # of all rates with the same words these are nearest to 1 in relative entropy: any exchange of words costs
        rate = np.minimum(2, np.exp(found * sizes / scale))
        n = words / sizes

        def entropy(r, n=n):
            return (n * (r * np.log(r) - r + 1)).sum()

        for a, b in rng.integers(0, 40, (60, 2)):
            other = rate.copy()
            step = 1e-4 * min(words[a], words[b])
            other[a] += step / words[a]
            other[b] -= step / words[b]
            if a != b and other[a] <= 2 and other[b] > 0:
                assert entropy(other) >= entropy(rate) - 1e-9


def test_levels_keep_the_order_of_sizes(spark):
    rows = spark.range(0, 40000, 7).select("id", mixing.level_of(F.col("id")).alias("level")).orderBy("id").collect()
    levels = [r.level for r in rows]
    assert levels == sorted(levels)
    spans: dict = {}
    for r in rows:
        spans.setdefault(r.level, []).append(r.id)
    assert all(max(x) - min(x) <= min(x) / 256 for x in spans.values())


def test_small_tables_join_the_same_in_cells(spark, monkeypatch):
    rows = spark.range(3000).select("id", (F.col("id") % 3).alias("key"))
    table = spark.createDataFrame([(0, "a", [1, 2]), (1, "b" * 50, None)], "key long, value string, cells array<long>")
    assert [r[0] for r in table.select(shared._bytes(table)).collect()] == [24 + 1 + 32, 24 + 50]
    whole = sorted(map(repr, shared.joined_small(rows, table, ["key"]).collect()))
    assert len(whole) == 2000
    for bound in ("BROADCAST_ROWS", "BROADCAST_BYTES"):
        with monkeypatch.context() as patch:
            patch.setattr(shared, bound, 1)
            joined = shared.joined_small(rows, table, ["key"])
            assert "Broadcast" not in joined._jdf.queryExecution().optimizedPlan().toString() and "broadcast" not in joined._jdf.queryExecution().optimizedPlan().toString()
            assert sorted(map(repr, joined.collect())) == whole


def test_hot_level_is_dealt_to_cells(spark):
    """Five thousand documents of one size: the level's extra copies are given exactly, by cells."""
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.when(F.col("id") < 4000, "a").otherwise("b").alias("source"))
    found = mixing.rates(docs).join(docs, "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("copies").alias("most")).collect()
    assert all(abs(r.taken - r.target) <= 3 and r.most <= 2 for r in found)
    mixed = mixing.mix(docs.withColumn("level", F.lit(1)).withColumn("draw", F.lit(2)))
    assert mixed.columns == ["doc_id", "text", "source", "level", "draw"]
    assert abs(mixed.count() * 3 - sum(r.target for r in found)) <= 6


def test_query_is_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    wanted = con.execute(queries.ORACLE_SQL["op4_mixing"])
    names = [c[0] for c in wanted.description]
    found = queries.QUERIES["op4_mixing"](spark, "/root/testdata/sf0.001").select(*names).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, wanted.fetchall()))
