"""Token counts as delta-maintained rollups."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer_version"]
SCHEMA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


def signed(changes: DataFrame) -> DataFrame:
    """Changes as additive rows (keys, n_docs, n_tokens).

    `changes` has the keys, op, n_tokens and old_n_tokens. An insert adds a document and its tokens, a delete takes
    them away, a revise adds the difference of its new and its old count. Null counts are 0; null keys are keys; rows
    with another op are refused when the rows are read. A repeated row is another change.
    """
    new, old = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_n_tokens", F.lit(0))
    op = F.col("op")
    docs = F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0).otherwise(F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce(op, F.lit("null")))))
    tokens = F.when(op == "insert", new).when(op == "delete", -new).otherwise(new - old)
    return changes.select(*KEYS, docs.cast("long").alias("n_docs"), tokens.cast("long").alias("n_tokens"))


def summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


class Rollup:
    """Totals by source, language and tokenizer version under a shared folder.

    Each batch is summed before it is stored, a row a key, in a folder named after the batch. The folder appears by
    one rename of a finished table: a batch that is applied again, or whose first try died half way, counts once.
    Totals are the sum of the latest snapshot and of the batches that it doesn't cover. One writer at a time. The rename is
    atomic on HDFS and local file systems, not on all object stores. A batch without rows commits and changes nothing;
    without any batch there are no totals.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = lambda *x: path("/".join([self.root, *x]))
        self._fs = self._path("x").getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, kind: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(kind))) if self._fs.exists(self._path(kind)) else []

    def _commit(self, df: DataFrame, kind: str, name: str) -> bool:
        draft = ["drafts", uuid.uuid4().hex]
        df.write.parquet("/".join([self.root, *draft]))
        self._fs.mkdirs(self._path(kind))
        if not self._fs.exists(self._path(kind, name)) and self._fs.rename(self._path(*draft), self._path(kind, name)):
            return True
        self._fs.delete(self._path(*draft), True)
        return False

    def batches(self) -> list[str]:
        return self._names("batches")

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit a batch; False if it was committed before, when nothing changes."""
        if batch in self.batches():
            return False
        return self._commit(summed(signed(changes)).where("n_docs != 0 OR n_tokens != 0"), "batches", batch)

    def _read(self, kind: str, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*("/".join([self.root, kind, n]) for n in names))

    def totals(self) -> DataFrame:
        """(keys, n_docs, n_tokens); keys whose documents are all gone are left out."""
        snapshots = self._names("snapshots")
        covered = set(self._names(f"covered/{snapshots[-1]}")) if snapshots else set()
        rest = self._read("batches", [b for b in self.batches() if b not in covered])
        return summed(self._read("snapshots", snapshots[-1:]).unionByName(rest)).where("n_docs != 0 OR n_tokens != 0")

    def compact(self) -> None:
        """Write a snapshot that covers all batches so far; their names stay, so that none counts again."""
        name = f"{len(self._names('snapshots')):08d}"
        for b in self.batches():
            self._fs.mkdirs(self._path("covered", name, b))
        self._commit(self.totals(), "snapshots", name)
