"""Keyed tables that are rewritten and swapped: a version is a folder, and the newest whole one is the table.

The job that writes a version marks it as done when all its files are there, so a reader sees the old table or the new one and never
half of one. Two writers at once are not kept apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Store:
    """Tables by name under a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _versions(self, name: str) -> list[int]:
        """The numbers of the versions that were written to their end."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        files = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(root):
            return []
        found = [x.getPath() for x in files.listStatus(root)]
        return sorted(int(p.getName()) for p in found if p.getName().isdigit() and files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def read(self, name: str, shape: str) -> DataFrame:
        """The table, or no rows of ``shape`` if there is none yet; columns that it was stored without are null."""
        versions = self._versions(name)
        if not versions:
            return self.spark.createDataFrame([], shape)
        return self.spark.read.schema(shape).parquet(f"{self.folder}/{name}/{versions[-1]}")

    def replace(self, name: str, rows: DataFrame) -> DataFrame:
        """Make ``rows``, which may be read from the table itself, the table."""
        number = (self._versions(name) or [0])[-1] + 1
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/{number}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{name}/{number}")

    def prune(self, name: str, keep: int = 2) -> None:
        """Delete all but the newest versions; readers of older ones must be done."""
        jvm = self.spark.sparkContext._jvm
        for number in self._versions(name)[:-keep]:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/{number}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
