"""Incremental runs over what has come in since the last one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, table: str, schema: str, glob: str = "*.parquet") -> DataFrame:
    """The rows of a parquet table, which may be one file or a folder of them, as they come in. As a pattern, as Spark takes
    a single file's path for that of a folder."""
    at = table.rstrip("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(f"{at[:-1]}[{at[-1]}]")


def first_seen(rows: DataFrame, text: str = "text", within: str | None = None, ts: str | None = None) -> DataFrame:
    """The first row of each text that arrives, by the text's hash `h`.

    The state holds one hash a text, in the executors' state stores; with `ts` and `within` only hashes of that span.
    """
    hashed = rows.withColumn("h", F.sha2(F.col(text), 256))
    return hashed.withWatermark(ts, within).dropDuplicatesWithinWatermark(["h"]) if within and ts else hashed.dropDuplicates(["h"])


def run_once(rows: DataFrame, sink: str, checkpoint: str, step: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """All that is there now, in batches, through `step` into parquet.

    Each batch overwrites a folder of its own, so one that is run again after a loss leaves no row twice. Where nothing has
    come in, `sink` is an empty folder.
    """
    at = rows.sparkSession._jvm.org.apache.hadoop.fs.Path(sink)
    at.getFileSystem(rows.sparkSession._jsc.hadoopConfiguration()).mkdirs(at)

    def put(batch: DataFrame, number: int) -> None:
        (step(batch) if step else batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
