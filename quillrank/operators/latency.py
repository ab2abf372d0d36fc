"""Latency of stages: exact percentiles, ordered reports, and recorders that are merged or go on from run to run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillrank import config

SAMPLES = "stage string, ms double"
POINTS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def counted(samples: DataFrame) -> DataFrame:
    """(stage, ms, n) of samples (stage, ms): each value once. Nulls and negative durations are left out."""
    return samples.where("ms >= 0").groupBy("stage", "ms").agg(F.count("*").alias("n"))


def statistics(values: DataFrame) -> DataFrame:
    """(stage, count, mean_ms, min_ms, max_ms, p50, p95, p99), rounded to 3 places, of counted values (stage, ms, n).

    Percentiles are exact and interpolated. Values are numbered in two steps, within parts of growing width and then over
    the parts' sums, so that a stage with most of all samples is no single task's.
    """
    part = F.floor(F.log1p("ms") * 1_024)
    rows = values.withColumn("part", part)
    sums = rows.groupBy("stage", "part").agg(F.sum("n").alias("here"))
    line = Window.partitionBy("stage").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("stage", "part", F.coalesce(F.sum("here").over(line), F.lit(0)).alias("before"), F.sum("here").over(Window.partitionBy("stage")).alias("count"))
    within = Window.partitionBy("stage", "part").orderBy("ms").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("at", F.coalesce(F.sum("n").over(within), F.lit(0))).join(sums, ["stage", "part"]).withColumn("first", F.col("before") + F.col("at"))

    def point(p: float) -> Column:
        rank = p * (F.max("count") - 1)
        at = lambda i: F.max(F.when((F.col("first") <= i) & (i < F.col("first") + F.col("n")), F.col("ms")))
        place = p * (F.col("count") - 1)
        low, high = at(F.floor(place)), at(F.ceil(place))
        between = (F.ceil(rank) - rank) * low + (rank - F.floor(rank)) * high
        return F.round(F.when(F.floor(rank) == F.ceil(rank), low).otherwise(between), 3)

    return placed.groupBy("stage").agg(
        F.max("count").alias("count"), F.round(F.sum(F.col("ms") * F.col("n")) / F.max("count"), 3).alias("mean_ms"), F.round(F.min("ms"), 3).alias("min_ms"), F.round(F.max("ms"), 3).alias("max_ms"),
        *(point(p).alias(name) for name, p in POINTS.items()),
    )


def report(values: DataFrame, stages: list[str] = config.STAGES) -> DataFrame:
    """Statistics with each stage's place (known ones in their order, then others by name) and all stages' samples."""
    stats = statistics(values)
    known = F.array_position(F.array(*map(F.lit, stages)), F.col("stage"))
    place = F.when(known > 0, known).otherwise(len(stages) + 1).cast("long")
    # a row a stage
    order = Window.orderBy("_place", "stage")
    return stats.withColumn("_place", place).select(F.row_number().over(order).cast("long").alias("place"), *stats.columns, F.sum("count").over(Window.partitionBy()).alias("total_samples"))


def merged(*recorders: DataFrame) -> DataFrame:
    """The samples of several recorders as one, equal ones each."""
    out = recorders[0].select("stage", "ms")
    for other in recorders[1:]:
        out = out.unionByName(other.select("stage", "ms"))
    return out


def from_reports(reports: DataFrame) -> DataFrame:
    """Counted values from reports without samples: each stage's mean, as often as it was counted. Loses the spread."""
    return reports.where("count > 0 AND mean_ms IS NOT NULL").groupBy("stage", F.col("mean_ms").alias("ms")).agg(F.sum("count").alias("n"))


def load(spark: SparkSession, path: str) -> DataFrame:
    """The samples of earlier runs; none if there is no such folder. Lines that are no samples are left out."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], SAMPLES)
    return spark.read.schema(SAMPLES).option("mode", "DROPMALFORMED").json(path).where("stage IS NOT NULL AND ms IS NOT NULL")


def save(samples: DataFrame, path: str) -> None:
    """Add a run's samples to those of earlier runs."""
    samples.select("stage", "ms").write.mode("append").json(path)
