"""A taxonomy that grows: what is near no canonical entry becomes one, in order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.functions.text import strip
from quillrank.operators.ranking import met_in_blocks, units
from quillrank.session import scratch_folder

#: Rows, and canonical entries, that meet in one task; and rows that are taken in order at once.
BLOCK = 2_048


def _best(group: pa.Table, ordered: bool) -> pa.Table:
    """For each row of the block the nearest entry (if `ordered`, that came no later): (at, cos, canon)."""
    rows, known = (group.filter(pc.equal(group["side"], s)) for s in (0, 1))
    if not len(rows) or not len(known):
        return pa.table({"at": pa.array([], pa.int64()), "cos": pa.array([], pa.float64()), "canon": pa.array([], pa.int64())})
    at, entry = np.array(rows["at"]), np.array(known["at"])
    order = np.argsort(entry)
    entry = entry[order]
    cos = np.round(units(rows["vec"]) @ units(known["vec"])[order].T, 9)
    if ordered:
        cos[entry[None, :] > at[:, None]] = -2
    pick = cos.argmax(axis=1)
    found = cos[np.arange(len(at)), pick] > -2
    return pa.table({"at": pa.array(at[found]), "cos": pa.array(cos[np.arange(len(at)), pick][found]), "canon": pa.array(entry[pick][found])})


def nearest(rows: DataFrame, entries: DataFrame, ordered: bool = True) -> DataFrame:
    """(at, cos, canon): for each of `rows` (at, vec) the entry (at, vec) of greatest cosine, if `ordered` among those that came
    no later; of equal ones the earliest. Blocks of rows meet blocks of entries, so neither side is sent whole to a task."""
    vec = F.col("vec").cast("array<float>").alias("vec")
    sides = (df.select("at", vec) for df in (rows, entries))
    found = met_in_blocks(*sides, "at", ["vec"], BLOCK, BLOCK).applyInArrow(lambda group: _best(group, ordered), "at long, cos double, canon long")
    return found.groupBy("at").agg(F.max(F.struct("cos", (-F.col("canon")).alias("canon"))).alias("b")).select("at", "b.cos", (-F.col("b.canon")).alias("canon"))


def _in_order(least: float):
    def leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).sort_by("at")
        x = units(rows["vec"])
        near, taken = np.round(x @ x.T, 9) > least, []
        for i in range(len(x)):
            if not near[i, taken].any():
                taken.append(i)
        yield from rows.take(pa.array(taken, pa.int64())).to_batches()

    return leaders


class Taxonomy:
    """Canonical entries (at, name, vec) in shared storage, a folder for each batch that added some.

    A batch that is run again sees only what the batches before it added, and overwrites its own folder.
    """

    def __init__(self, like: DataFrame, least: float = 0.85, root: str | None = None):
        self.spark, self.least, self.root = like.sparkSession, least, root or scratch_folder(like.sparkSession)

    def entries(self, before: int | None = None) -> DataFrame:
        """All canonical entries, or those that batches before a number added."""
        numbers = [n for n in self._numbers() if before is None or n < before]
        rows = self.spark.createDataFrame([], "at long, name string, vec array<float>")
        return self.spark.read.schema(rows.schema).parquet(*(f"{self.root}/entries/{n:012d}" for n in numbers)) if numbers else rows

    def _numbers(self) -> list[int]:
        """Batches whose entries are written whole."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/entries")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        done = lambda s: fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(at) if done(s)) if fs.exists(at) else []

    def _saved(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def add(self, batch: DataFrame, number: int) -> DataFrame:
        """(at, name, canonical, cos) of a batch (at: place in the order of all batches, name, vec), which may grow the
        taxonomy.

        Names are put in lower case and stripped, blank ones are left out. One by one, in order, each name maps to the
        canonical entry of greatest cosine among those before it, if that is over `least`; otherwise it becomes one. Here
        all meet the entries of earlier batches first, in blocks; only those near none are then taken in order, BLOCK at a
        time: what a block adds meets all rows behind it at once. A vector that is null, zero or of another length than
        the entries' has no cosine with anything, and its name is canonical as it is.
        """
        name = strip(F.lower("name"))
        rows = self._saved(batch.select("at", name.alias("name"), "vec").where(name != ""), f"work/{number}/rows")
        square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        good = rows.where(F.coalesce(square > 0, F.lit(False)))
        known = self.entries(number)
        alone = rows.join(good.select("at"), "at", "left_anti")
        first = self._saved(nearest(good, known.where(F.size("vec") > 0)), f"work/{number}/first")
        rest = self._saved(good.join(first.where(F.col("cos") > self.least), "at", "left_anti"), f"work/{number}/rest-0")
        added, k = [], 0
        while rest.count():
            head = self._saved(rest.orderBy("at").limit(BLOCK), f"work/{number}/head-{k}")
            added.append(self._saved(head.coalesce(1).mapInArrow(_in_order(self.least), head.schema), f"work/{number}/added-{k}"))
            last = head.agg(F.max("at")).first()[0]
            behind = rest.where(F.col("at") > last)
            near = nearest(behind, added[-1]).where(F.col("cos") > self.least)
            k += 1
            rest = self._saved(behind.join(near, "at", "left_anti"), f"work/{number}/rest-{k}")
        new = known.limit(0)
        for more in added:
            new = new.unionByName(more)
        named = alone.groupBy("name").agg(F.min("at").alias("at")).join(known.select("name"), "name", "left_anti")
        grown = new.unionByName(named.select("at", "name", F.array().cast("array<float>").alias("vec")))
        grown = self._saved(grown, f"entries/{number:012d}")
        both = first.unionByName(nearest(good, grown.where(F.size("vec") > 0)))
        best = both.groupBy("at").agg(F.max(F.struct("cos", (-F.col("canon")).alias("canon"))).alias("b")).select("at", "b.cos", (-F.col("b.canon")).alias("canon"))
        canonical = known.unionByName(grown).select(F.col("at").alias("canon"), F.col("name").alias("canonical"))
        mapped = rows.select("at", "name").join(best, "at", "left").join(canonical, "canon", "left")
        out = mapped.select("at", "name", F.coalesce("canonical", "name").alias("canonical"), "cos")
        return self._saved(out, f"mapped/{number:012d}")

    def stream(self, batches: DataFrame, checkpoint: str) -> None:
        """Add all that a stream (at, name, vec) has now, a batch after another."""
        put = lambda df, number: self.add(df, number) and None
        batches.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    def mapped(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/mapped/*")


def once_each(canonical: Column) -> Column:
    """A list's canonical names, each once, in the order of their first."""
    return F.array_distinct(canonical)
