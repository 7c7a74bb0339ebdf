"""Connected components by alternating large and small stars.

Every round is a grouped minimum and an equi-join, both in cells of a hub's edges, so that these are never
gathered in one place; each round's edges are written to the shared scratch folder to cut lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.shared import materialize, with_least


def _stars(edges: DataFrame) -> DataFrame:
    """Per edge (u, v) the least of u and all its neighbours."""
    return with_least(edges, "u", "v", "m").withColumn("m", F.least("m", "u"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _stars(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    starred = _stars(edges)
    return (
        starred.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionAll(starred.select("u", F.col("m").alias("v")))
        .where("u > v")
        .distinct()
    )


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``edges`` (u, v) of any orderable type -> (node, root), root the least node of the component.

    Only nodes that have an edge to another node appear. Repeated edges, loops and null ends do no harm
    (loops and nulls are left out). No edges give no rows.
    """
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), (F.col("u") != F.col("v")).alias("k"))
    now = materialize(now.where("k and u is not null and v is not null").select("u", "v").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = mark
        now = materialize(_small_star(_large_star(now)), "edges")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
