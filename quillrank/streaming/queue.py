"""A queue of files with states, and keys that were seen, both kept as tables instead of a stream's state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What may follow on each state.
MOVES = {"uploaded": ["processing"], "processing": ["processed", "duplicate", "failed"]}


class _Steps:
    """Folders of rows, one for each step; only those that are written whole are read."""

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def names(self) -> list[str]:
        at = self._path("")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(at) if fs.exists(self._path(f"{s.getPath().getName()}/_SUCCESS")))

    def read(self, names: list[str]) -> DataFrame:
        empty = self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(empty.schema).parquet(*(f"{self.root}/{n}" for n in names)) if names else empty

    def write(self, rows: DataFrame, name: str) -> DataFrame:
        rows.select(*self.spark.createDataFrame([], self.schema).columns).write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.read([name])

    def drop(self, names: list[str]) -> None:
        for n in names:
            at = self._path(n)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


class Queue:
    """Rows by id that go from uploaded over processing to processed, duplicate or failed, each once.

    Every change of state is a row of a log, written by steps with numbers. A step that is run again after a loss claims the
    rows that it had claimed and overwrites its own results, so nothing is done twice, and what failed isn't tried again.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.log = _Steps(spark, root, "id long, state string, reason string, step long")

    def _known(self, before: str) -> DataFrame:
        return self.log.read([n for n in self.log.names() if n < before])

    def submit(self, rows: DataFrame, step: int) -> None:
        """Rows (id) come in as uploaded; ids that an earlier step brought, and repeated ones, are left out."""
        name = f"{step:012d}-0-uploaded"
        new = rows.select(F.col("id").cast("long").alias("id")).distinct().join(self._known(name).select("id"), "id", "left_anti")
        self.log.write(new.withColumns({"state": F.lit("uploaded"), "reason": F.lit(None).cast("string"), "step": F.lit(step).cast("long")}), name)

    def claim(self, step: int) -> DataFrame:
        """(id) of all that wait: uploaded and not claimed by another step. They are processing now."""
        name = f"{step:012d}-1-processing"
        if name not in self.log.names():
            known = self._known(name)
            waiting = known.where("state = 'uploaded'").select("id").join(known.where("state != 'uploaded'").select("id"), "id", "left_anti")
            self.log.write(waiting.withColumns({"state": F.lit("processing"), "reason": F.lit(None).cast("string"), "step": F.lit(step).cast("long")}), name)
        return self.log.read([name]).select("id")

    def finish(self, step: int, results: DataFrame) -> None:
        """Results (id, state, reason) of claimed rows; rows that the step hasn't claimed are left out, claimed ones that
        have no result or none of the states that may follow have failed."""
        fine = F.coalesce(F.col("state").isin(*MOVES["processing"]), F.lit(False))
        rows = self.claim(step).join(results.select("id", "state", "reason").dropDuplicates(["id"]), "id", "left")
        rows = rows.select("id", F.when(fine, F.col("state")).otherwise("failed").alias("state"), F.when(fine, F.col("reason")).otherwise("no result").alias("reason"), F.lit(step).cast("long").alias("step"))
        self.log.write(rows, f"{step:012d}-2-done")

    def run(self, step: int, work: Callable[[DataFrame], DataFrame]) -> None:
        """Claim, work on what is claimed (id), write the results. A step that is done isn't done again."""
        if f"{step:012d}-2-done" not in self.log.names():
            self.finish(step, work(self.claim(step)))

    def states(self) -> DataFrame:
        """(id, state, reason, changes): where each row is now."""
        rank = F.when(F.col("state") == "uploaded", 0).when(F.col("state") == "processing", 1).otherwise(2)
        rows = self.log.read(self.log.names()).withColumn("_rank", rank)
        return rows.groupBy("id").agg(F.max_by(F.struct("state", "reason"), "_rank").alias("s"), F.count("*").alias("changes")).select("id", "s.state", "s.reason", "changes")

    def stream(self, rows: DataFrame, checkpoint: str, work: Callable[[DataFrame], DataFrame]) -> None:
        """All that a stream (id) has now: each batch is submitted, claimed and worked on as a step of its number."""

        def put(batch: DataFrame, number: int) -> None:
            self.submit(batch, number)
            self.run(number, work)

        rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class Seen:
    """Keys that were seen, in a table by buckets of their hashes: a batch is checked by an anti-join, and no stream holds
    state. Steps are merged into one table of buckets after every `merge` of them."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, merge: int = 16):
        self.keys, self.buckets, self.merge = _Steps(spark, f"{root}/keys", "bucket int, h string"), buckets, merge

    def first(self, batch: DataFrame, number: int, text: str = "text", order: str = "id") -> DataFrame:
        """The rows of a batch whose text no earlier batch had, of equal ones the first by `order`; the others go. A null
        text is no text: such rows stay all. The last batch, if it is run again, gives the same."""
        name = f"{number:012d}"
        h = F.sha2(F.col(text), 256)
        rows = batch.withColumn("h", h).withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(self.buckets)).cast("int"))
        old = self.keys.read([n for n in self.keys.names() if n < name])
        least = rows.where("h IS NOT NULL").groupBy("bucket", "h").agg(F.min(order).alias("_first")).join(old, ["bucket", "h"], "left_anti")
        new = self.keys.write(least.select("bucket", "h").repartition("bucket").sortWithinPartitions("bucket", "h"), name)
        self._merged(name)
        kept = rows.join(new, ["bucket", "h"], "left_semi")
        best = kept.groupBy("bucket", "h").agg(F.min(order).alias("_first"))
        kept = kept.join(best, ["bucket", "h"]).where(F.col(order) == F.col("_first")).drop("_first")
        return kept.unionByName(rows.where("h IS NULL").select(*kept.columns)).drop("h", "bucket")

    def _merged(self, upto: str) -> None:
        """Earlier steps become one, under the name of the last of them; what a kill leaves twice is read as it is."""
        old = [n for n in self.keys.names() if n < upto]
        if len(old) >= self.merge:
            whole = self.keys.read(old).distinct().repartition("bucket").sortWithinPartitions("bucket", "h")
            self.keys.write(whole, f"{old[-1]}-merged")
            self.keys.drop(old)
