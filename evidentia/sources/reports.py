"""Ground truth in, reports out, and sets of documents to measure with: JSON files through Spark's reader and writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TRUTH = "id string, file string, title string, author string, layout string, expect string, probe string, lang string"
LEAST_BYTES = 8000


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """The rows of ground-truth files, each a JSON array; fields that a file lacks are null."""
    return spark.read.schema(TRUTH).option("multiLine", True).json(path)


def write_report(rows: DataFrame, summary: DataFrame, path: str) -> None:
    """Scored rows as JSON lines, and their summary beside them, as JSON and as a table in Markdown; what was there is replaced."""
    rows.write.mode("overwrite").json(f"{path}/rows")
    summary.write.mode("overwrite").json(f"{path}/summary")
    markdown(summary).coalesce(1).write.mode("overwrite").text(f"{path}/markdown")


def markdown(summary: DataFrame) -> DataFrame:
    """The lines (value) of a Markdown table of a summary, in order: a heading and a line per row."""
    spark, columns = summary.sparkSession, summary.columns

    def cells(values: list[Column]) -> Column:
        return F.concat(F.lit("| "), F.concat_ws(" | ", *values), F.lit(" |"))

    body = summary.select(F.lit(2).alias("part"), cells([F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns]).alias("value"))
    head = spark.createDataFrame([(0, f"| {' | '.join(columns)} |"), (1, f"|{'---|' * len(columns)}")], "part int, value string")
    return head.unionAll(body).orderBy("part", "value").select("value")


def benchmark_set(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """Per wanted title (id, query) the first of its search results (id, place, title, author_name, bytes) that can be measured with.

    A result needs a title, an author and an image of ``LEAST_BYTES`` or more; titles without such a result are left out.
    """
    fits = found.where((F.coalesce("title", F.lit("")) != "") & (F.coalesce(F.size("author_name"), F.lit(0)) > 0) & (F.coalesce("bytes", F.lit(0)) >= LEAST_BYTES))
    first = fits.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("place"))).where("nth = 1")
    return wanted.join(first, "id").select("id", "title", F.get("author_name", F.lit(0)).alias("author"), "bytes")
