"""Several tables that change together, by one pointer."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Versions:
    """Tables under a folder, whose rows belong to owners (jobs). A commit writes new rows of all tables into a folder of its
    own and a manifest, a table of which version holds each owner's rows; then a file that names the manifest is put in the
    old one's place by a rename. Readers see all of a commit or nothing of it, and a commit that is killed leaves nothing
    that is read. One writer at a time. The rename is atomic on HDFS and local file systems, not on all object stores.
    """

    def __init__(self, spark: SparkSession, root: str, by: str = "job"):
        self.spark, self.root, self.by = spark, root.rstrip("/"), by

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def current(self) -> str | None:
        """The version that readers see."""
        if not self._fs().exists(self._path("CURRENT")):
            return None
        return self.spark.read.text(f"{self.root}/CURRENT").first()[0]

    def manifest(self, version: str | None) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.root}/{version}/manifest") if version else None

    def prepare(self, tables: dict[str, DataFrame], owners: DataFrame | None = None) -> str:
        """Write a version that nobody sees yet. `owners` (a column `by`) are those whose rows are replaced, those of the
        first table if not given; an owner without rows in a table has none there any more."""
        version = f"v{uuid.uuid4().hex[:12]}"
        for name, rows in tables.items():
            # sorted, so that a reader of one owner skips what its statistics exclude; an empty table keeps its columns
            rows.sortWithinPartitions(self.by).write.parquet(f"{self.root}/{version}/{name}")
        first = next(iter(tables))
        owners = self.spark.read.parquet(f"{self.root}/{version}/{first}") if owners is None else owners
        new = owners.select(F.col(self.by).cast("string").alias(self.by)).distinct().withColumn("version", F.lit(version))
        old = self.manifest(self.current())
        both = new if old is None else new.unionByName(old.join(new, self.by, "left_anti"))
        both.write.parquet(f"{self.root}/{version}/manifest")
        return version

    def publish(self, version: str) -> None:
        """Make a prepared version the one that is read."""
        jvm, fs = self.spark._jvm, self._fs()
        draft = self._path(f"{version}/CURRENT")
        out = fs.create(draft, True)
        out.write(bytearray(version.encode()))
        out.close()
        at = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        at.rename(at.makeQualified(draft), at.makeQualified(self._path("CURRENT")), options)

    def commit(self, tables: dict[str, DataFrame], owners: DataFrame | None = None) -> str:
        version = self.prepare(tables, owners)
        self.publish(version)
        return version

    def read(self, name: str, version: str | None = None) -> DataFrame:
        """A table as it is now, or as of a version. Only folders that the manifest names are read."""
        manifest = self.manifest(version or self.current())
        if manifest is None:
            raise ValueError("nothing is published")
        live = [r["version"] for r in manifest.select("version").distinct().collect()]
        rows = None
        for v in live:
            if self._fs().exists(self._path(f"{v}/{name}/_SUCCESS")):
                own = manifest.where(F.col("version") == v).select(F.col(self.by).alias("_owner"))
                part = self.spark.read.parquet(f"{self.root}/{v}/{name}")
                part = part.join(own, part[self.by].cast("string") == own["_owner"], "left_semi")
                rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
        return rows

    def vacuum(self) -> list[str]:
        """Remove the folders of versions that the current manifest doesn't name."""
        now = self.current()
        keep = {now, *(r["version"] for r in self.manifest(now).select("version").distinct().collect())}
        gone = [s.getPath().getName() for s in self._fs().listStatus(self._path("")) if s.isDirectory() and s.getPath().getName() not in keep]
        for v in gone:
            self._fs().delete(self._path(v), True)
        return gone
