"""Times of a stream's stages, as samples of the latency log."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class StageTimes(StreamingQueryListener):
    """Collects (query, batch, stage, ms) of every batch of the streams that run while it is added to the session.

    A row a stage and batch is held by the driver until it is taken.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.rows, self.lock = spark, [], threading.Lock()

    def __enter__(self) -> StageTimes:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        with self.lock:
            self.rows += [(p.name or str(p.id), p.batchId, stage, float(ms)) for stage, ms in p.durationMs.items()]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def take(self) -> DataFrame:
        """What has come in since the last time."""
        with self.lock:
            rows, self.rows = self.rows, []
        return self.spark.createDataFrame(rows, "query string, batch long, stage string, ms double")
