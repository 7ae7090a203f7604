"""A job's intermediate tables, below the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Only where it is unset and all runs in one process is a temporary folder taken."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """A folder of its own for one job; ``release`` deletes it with all its tables."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark, self.root, self._n = spark, f"{shared_dir(spark)}/{job}-{uuid.uuid4().hex}", 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` and returns it as read back: what is built on it costs a read, and a lost executor no more."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def observed(self, df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict]:
        """``save``, and the measures (aggregates) of the rows, taken while they are written."""
        seen = Observation()
        saved = self.save(df.observe(seen, *(m.alias(k) for k, m in measures.items())), name)
        return saved, seen.get

    def release(self) -> None:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
