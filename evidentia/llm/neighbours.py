"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected to a few dimensions, once per curve, and ordered by the Hilbert index of the shifted projection; Spark range-partitions
each ordering. A query looks at a window of neighbours on every curve; the windows are merged and ranked by the exact distance of
the original vectors. Equal vectors are one node of the index, which keeps as many of their least ids as an answer may need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.shared import joined_small, materialize

CURVES = 16
DIMENSIONS = 8
BITS = 7
#: The projections are scaled by the mean and spread of about so many vectors; every vector is indexed.
SAMPLE = 4096
#: A window's share of all vectors, and its least number of rows. Neighbours that stand out need little; in the
#: evenly spread test vectors the nearest is hardly nearer than any other, and recall is bought by width.
SHARE = 0.06
LEAST_WINDOW = 512
BLOCK = 1024
#: A task of the search compares one block with about this many queries.
ASKED = 4096


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of every row of ``cells`` (integers below ``2**bits``); columns times bits is 63 at most."""
    axes = cells.astype(np.int64).T.copy()
    top = 1 << (bits - 1)
    q = top
    while q > 1:  # undo the turns and mirrors of each level, from the coarsest
        below = q - 1
        for axis in axes:
            mirrored = (axis & q) > 0
            swapped = np.where(mirrored, 0, (axes[0] ^ axis) & below)
            axes[0] ^= np.where(mirrored, below, swapped)
            axis ^= swapped
        q >>= 1
    for i in range(1, len(axes)):  # Gray code
        axes[i] ^= axes[i - 1]
    turn = np.zeros(axes.shape[1], np.int64)
    q = top
    while q > 1:
        turn ^= np.where(axes[-1] & q, q - 1, 0)
        q >>= 1
    axes ^= turn
    key = np.zeros(axes.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << 1) | ((axis >> bit) & 1)
    return key


def _curve(number: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([2, number, width])
    directions = np.linalg.qr(rng.normal(size=(width, width)))[0][:, : min(DIMENSIONS, width)]
    return directions, rng.random(directions.shape[1])


def _keys(vectors: np.ndarray, number: int, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    directions, shift = _curve(number, vectors.shape[1])
    scaled = (vectors @ directions - mean @ directions) / np.maximum(np.sqrt(((spread @ directions) * directions).sum(axis=0)), 1e-12)
    unit = (scaled / 6 + 0.5 + shift / 2) / 1.5
    return hilbert_index(np.clip(unit * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64), BITS)


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(v.isNotNull() & F.col(id_col).isNotNull()).where(whole)
    return rows.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: x.cast("double")).alias("vector"))


_QUERIES = 16


def _search(number: int):
    """Per curve and block: for each query there, the ``number`` nearest nodes of the block."""

    def search(data: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, float]] = []
        if len(data) and len(queries):
            nodes, x = data["node"].to_numpy(), np.stack(data["vector"].to_numpy())
            wanted, q = queries["query"].to_numpy(), np.stack(queries["sought"].to_numpy())
            for i in range(0, len(q), _QUERIES):
                rough = np.sqrt(((q[i : i + _QUERIES, None] - x[None]) ** 2).sum(axis=2))
                for query, sought, d in zip(wanted[i : i + _QUERIES], q[i : i + _QUERIES], rough, strict=True):
                    limit = np.partition(d, number - 1)[number - 1] if len(d) > number else np.inf
                    near = np.flatnonzero(d <= limit * (1 + 1e-12))
                    # the score adds up component by component, in order, so that it is the same wherever it is worked out
                    exact = np.sqrt(np.cumsum((x[near] - sought) ** 2, axis=1)[:, -1])
                    order = np.lexsort((nodes[near], exact))[:number]
                    found += zip([query] * len(order), nodes[near][order], exact[order], strict=True)
        return pd.DataFrame(found, columns=["query", "node", "score"])

    return search


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", curves: int = CURVES, share: float = SHARE, least: int = LEAST_WINDOW) -> DataFrame:
    """(query_id, rank, id, score): for the rows whose id is divisible by ``every``, the ``k`` nearest other rows found.

    The score is the Euclidean distance in double precision; ties go to the smaller id. Rows whose vector or id is null, whose
    vector is zero or has a null or non-finite component, and those of another length than the most frequent one (the
    shorter of several), take no part. With no more rows than a window the search is exact. Rows that repeat an id are candidates each. No rows give no
    rows.
    """
    usable = _usable(vectors, id_col, vector_col)
    lengths = usable.groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "width").first()
    shape = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], shape)
    width, rows = lengths
    usable = materialize(usable.where(F.size("vector") == width), "vectors")
    members = usable.withColumn("place", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("place") <= k + 1)
    members = materialize(members.withColumn("node", F.min("id").over(Window.partitionBy("vector"))), "vector-members")
    nodes = members.where("place = 1").select("node", "vector")
    sample = nodes.where(F.pmod(F.xxhash64("node"), F.lit(max(1, rows))) < SAMPLE).select("vector").limit(4 * SAMPLE).collect() or nodes.select("vector").limit(1).collect()
    fitted = np.array([r[0] for r in sample])
    mean, spread = fitted.mean(axis=0), np.cov(fitted.T).reshape(width, width) if len(fitted) > 1 else np.eye(width)

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, width)
            for number in range(curves):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), number, np.int32)), pa.array(_keys(x, number, mean, spread)), batch.column(0), batch.column(1)], ["curve", "key", "node", "vector"])

    keyed = nodes.mapInArrow(ordered, "curve int, key long, node long, vector array<double>")
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = keyed.repartitionByRange(parts, "curve", "key", "node").sortWithinPartitions("curve", "key", "node")
    placed = materialize(sorted_.select("curve", "node", "vector", F.monotonically_increasing_id().alias("at")), "curves")
    sizes = dict(placed.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect())
    total = sum(sizes.values()) // curves
    starts, start = [], 0
    for part, n in sizes.items():
        starts.append((part, start))
        start += n
    begin = vectors.sparkSession.createDataFrame(starts, "part long, start long")
    placed = joined_small(placed.withColumn("part", F.shiftright("at", 33)), begin, ["part"])
    rank = F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) - F.col("curve").cast("long") * total
    ranked = placed.select("curve", "node", "vector", rank.alias("rank"))

    queries = usable.where(F.col("id") % every == 0)
    asked = queries.join(nodes, "vector").select(F.col("id").alias("query_id"), "node")
    asked = materialize(asked, "queries")
    half = min(total, max(least, int(share * total))) // 2 + 1
    low = F.greatest(F.lit(0), F.least(F.col("rank") - half, F.lit(total - 1 - 2 * half)))
    high = F.least(F.lit(total - 1), F.greatest(F.col("rank") + half, F.lit(2 * half)))
    wanted = materialize(asked.select("node").distinct(), "query-nodes")
    # a block meets a share of all queries: it is copied, so that each copy meets a bounded part of them
    copies = max(1, -(-wanted.count() * (2 * half + 1) // (total * ASKED)))
    windows = ranked.join(wanted, "node", "left_semi").select(
        F.pmod(F.xxhash64("node"), F.lit(copies)).cast("int").alias("for_copy"),
        F.col("curve").alias("on_curve"), F.col("node").alias("query"), F.col("vector").alias("sought"), F.explode(F.sequence(F.floor(low / BLOCK), F.floor(high / BLOCK))).alias("in_block")
    )
    blocks = ranked.select("curve", "node", "vector", F.floor(F.col("rank") / BLOCK).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
    merged = blocks.groupBy("curve", "block", "copy").cogroup(windows.groupBy("on_curve", "in_block", "for_copy")).applyInPandas(_search(k + 1), "query long, node long, score double")
    best = merged.groupBy("query", "node").agg(F.min("score").alias("score"))
    best = best.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("score", "node"))).where(F.col("place") <= k + 1)
    near = materialize(best.select("query", "node", "score"), "nearest-nodes")
    answers = asked.select("query_id", F.col("node").alias("query")).join(near, "query").join(members.select("node", "id"), "node").where("id != query_id")
    order = Window.partitionBy("query_id").orderBy("score", "id")
    found = answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
