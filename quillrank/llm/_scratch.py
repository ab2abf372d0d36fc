"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session. Where it is unset, a temporary folder on a single machine (tests), and an
    error on a cluster: no folder of the driver's is seen by its executors."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='quillrank-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def bounded_batches(spark: SparkSession, rows: int = 1_000, size: str = "8m") -> None:
    """Send texts to Python in batches of so many rows and bytes at most, unless the session's are smaller already.

    Spark's defaults of 10,000 rows and any number of bytes take hundreds of MB several times over. The settings are
    the session's and stay, as results are evaluated later.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


class Scratch:
    """Parquet tables under one folder of the shared directory.

    A saved table cuts the lineage: whatever is lost later is read again from shared storage. `last` keeps one table
    for the result, which is evaluated lazily, and drops the others.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """These tables, or all of them if none is named."""
        jvm = self.spark._jvm
        for path in map(self.path, names) if names else [self.root]:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def last(self, df: DataFrame) -> DataFrame:
        """`df` as the only table that is left."""
        path = f"{self.root}-result"
        df.write.mode("overwrite").parquet(path)
        self.drop()
        return self.spark.read.schema(df.schema).parquet(path)
