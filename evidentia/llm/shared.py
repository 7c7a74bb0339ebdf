"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType

#: Words are runs of anything but the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the master is local (tests, a laptop) a temporary folder of this machine is set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="evidentia-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root}/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it again: cuts lineage, survives lost executors.

    With ``tidy`` the shuffle files that the write needed go as soon as it is done; nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    kept = spark.conf.get(_CLEANUP)
    if tidy:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, kept)
    return spark.read.schema(df.schema).parquet(path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def discard(table: DataFrame) -> None:
    """Empty a table that ``materialize`` wrote, once nothing will read it any more."""
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        table.sparkSession.createDataFrame([], table.schema).write.mode("overwrite").parquet(folder)


#: Rows of one Arrow batch: documents are long, and a Python worker holds a whole batch.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows per Arrow batch to ``BATCH_ROWS``, from now on; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


#: Rows of one key are spread over so many cells where they meet something of their key.
SALTS = 64


def salt(*columns: str) -> Column:
    """The cell, of ``SALTS``, of a row of a group that may be hot."""
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` as a side of a join that meets the other by shuffling both: never sent whole to every task.

    Spark takes an exploded table for as large as the one that it was exploded from, and may broadcast what the driver can't hold.
    """
    return rows.hint("merge")


def with_least(rows: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """``rows`` with the least ``value`` of all rows of the same ``key`` as ``out``.

    Rows of one key are never gathered: they are reduced, and met by the result, in cells by a hash of ``value``. Only cells
    that hold a row get a copy of the result. Rows without a key are left out.
    """
    cell, cells = free_name(rows, "_cell"), free_name(rows, "_cells")
    placed = rows.withColumn(cell, salt(value))
    least = placed.groupBy(key, cell).agg(F.min(value).alias(out)).groupBy(key).agg(F.min(out).alias(out), F.collect_list(cell).alias(cells))
    return placed.join(dealt(least.select(key, F.explode(cells).alias(cell), out)), [key, cell]).drop(cell)


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Tables of no more rows and bytes than this, measured first, are sent to every task.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20


def _bytes(table: DataFrame) -> Column:
    """About what a row takes: eight bytes a value, sixteen an entry of an array, the bytes of strings."""
    total = F.lit(0).cast("long")
    for field in table.schema:
        at = F.col(f"`{field.name}`")
        size = F.size(at) * 16 if isinstance(field.dataType, ArrayType) else F.octet_length(at) if isinstance(field.dataType, (StringType, BinaryType)) else F.lit(0)
        total += F.lit(8) + F.coalesce(size, F.lit(0))
    return total


def joined_small(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` joined with a table of one row per key, of whatever number of keys, and however many rows share a key.

    A table of ``BROADCAST_ROWS`` rows and ``BROADCAST_BYTES`` at most is sent to every task. Beyond that both sides meet
    in cells of a key, of which every one has a copy of the table's row.
    """
    held = table.select(_bytes(table).alias("bytes")).limit(BROADCAST_ROWS + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    if held.n <= BROADCAST_ROWS and held.bytes <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table), keys)
    cell = free_name(rows, "_cell")
    placed = rows.withColumn(cell, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    copied = table.withColumn(cell, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return placed.join(dealt(copied), [*keys, cell]).drop(cell)


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts of an Arrow array in a row, and where each begins (with the end after the last); null texts are empty."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, begins, data = texts.buffers()
    offsets = np.frombuffer(begins, np.int64, len(texts) + 1, 8 * texts.offset) if begins else np.zeros(len(texts) + 1, np.int64)
    held = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return held[offsets[0] : offsets[-1]], offsets - offsets[0]
