"""A session with the settings that the operators count on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def session(app: str = "quillrank", master: str | None = None, **conf: str) -> SparkSession:
    """UTC and adaptive execution; sizes of partitions and clusters are left to the caller's configuration."""
    own = SparkSession.builder.appName(app)
    if master:
        own = own.master(master)
    for k, v in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", **conf}.items():
        own = own.config(k, v)
    return own.getOrCreate()


def scratch_folder(spark: SparkSession) -> str:
    """A new folder under `spark.checkpoint.dir`, which driver and executors share; it goes when the application ends. Where
    the setting is unset, a temporary one on a single machine (tests), and an error on a cluster."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = root or f"file://{tempfile.mkdtemp(prefix='quillrank-')}"
    path = f"{root.rstrip('/')}/{uuid.uuid4().hex[:12]}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(at)
    store.deleteOnExit(at)
    return path


def small_batches(spark: SparkSession, rows: int = 500, size: str = "8m") -> None:
    """Long lists and whole files go to Python in batches of so many rows and bytes at most, unless the session's are smaller
    already; the settings are the session's and stay, as results are evaluated later."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


@contextmanager
def set_for(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for what runs within."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
