"""Shared folder for intermediate tables.

Jobs cut lineage by writing Parquet below ``spark.checkpoint.dir``, the folder
that the cluster shares, so a lost executor costs a re-read and nothing more.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tamarack.sources.scratch import shared_dir


class Workspace:
    """A folder of its own for one job's intermediate tables."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{job}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as read back, with the same columns."""
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Delete a table that ``save`` returned and nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for file in df.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(conf).delete(folder, True)


def small_batches(spark: SparkSession, rows: int = 500, size: str = "4m") -> None:
    """Lets Arrow batches of this session be small: long texts and their results need memory at once.

    They hold at most ``rows`` rows and, unless the session sets a limit itself,
    little over ``size`` bytes; a longer text comes alone.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":  # Spark's own
        spark.conf.set(key, size)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int = 500, size: str = "4m") -> Iterator[None]:
    """``small_batches`` for the jobs that run inside; the session's own settings come back after them."""
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(k) for k in keys]
    small_batches(spark, rows, size)
    try:
        yield
    finally:
        for key, value in zip(keys, before):
            spark.conf.set(key, value)
