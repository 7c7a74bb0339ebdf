"""The tables of a folder in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One is appended to each document as a line, so that every rule has something to refuse.
NOISE = [
    "A Novel", "A New York Times Bestseller", "Winner of the Booker Prize", "International Bestseller", "Shortlisted for a prize", "Award-winning author",
    "Penguin Books", "— Village Voice", "The Guardian", "ISBN 9780141187761", "$14.99", "Translated by Ana Stone", "Now a major motion picture", "www.example.com", '"Simply the best there is"',
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt to all cores where a small file came in fewer parts than there are cores; larger tables stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, text) of the documents that have both."""
    return spread(table(spark, folder, "documents").where("text is not null and doc_id is not null").select("doc_id", "text"))


def lines(spark: SparkSession, folder: str, noisy: bool = False) -> DataFrame:
    """Documents as pages of lines read in two passes, with made-up places, sizes and confidences."""
    parts = F.split("text", "\n")
    if noisy:
        parts = F.concat(parts, F.array(F.get(F.array(*map(F.lit, NOISE)), F.pmod("doc_id", F.lit(len(NOISE))).cast("int"))))
    rows = documents(spark, folder).select("doc_id", (F.size(parts) * 60.0).alias("page_height"), F.posexplode(parts).alias("line_no", "text"))
    height = (F.lit(20) + (F.col("doc_id") * 7 + F.col("line_no") * 13) % 80).cast("double")
    rows = rows.select(
        F.col("doc_id").alias("scan_id"), (F.col("line_no") % 2).cast("int").alias("pass_no"), "line_no", "text", ((F.col("doc_id") * 31 + F.col("line_no") * 17) % 101).cast("double").alias("confidence"), height.alias("height"), "page_height"
    )
    top = F.col("line_no") * 60.0
    box = F.struct(F.lit(100.0).alias("x0"), top.alias("y0"), (F.length("text") * F.col("height") + 100.0).alias("x1"), (top + F.col("height")).alias("y1"))
    return rows.withColumn("bbox", box)


def parts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """Passages as titles to be found in documents."""
    rows = table(spark, folder, "benchmark")
    return rows.select(F.col("item_id").alias("doc_id"), F.col("text").alias("title"), F.array(F.lit("Ana Stone")).alias("author_name"), (F.col("item_id") % 50 + 1).cast("int").alias("edition_count"))


def books(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as books, dated by orders; a third of them have no status."""
    rows = parts(spark, folder).join(table(spark, folder, "orders"), F.col("p_partkey") == F.col("o_orderkey"))
    status = F.when(F.col("p_partkey") % 3 == 0, "read").when(F.col("p_partkey") % 3 == 2, "unread")
    return rows.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"), status.alias("status"), F.col("o_orderdate").alias("date_added"))


def lookups(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("key"), "ts")
