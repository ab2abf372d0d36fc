"""Latency reports over events: types as stages, values as milliseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.operators import latency as L
from quillrank.plans.base import query, table
from quillrank.session import scratch_folder

#: Two event types under names of known stages; the others are stages of their own.
NAMES = {"view": "parsing", "click": "ocr"}
_STAGE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NAMES.items()) + " ELSE event_type END"
_STATS = """count(*) AS count, round(avg(ms), 3) AS mean_ms, round(min(ms), 3) AS min_ms, round(max(ms), 3) AS max_ms, round(quantile_cont(ms, 0.5), 3) AS p50,
  round(quantile_cont(ms, 0.95), 3) AS p95, round(quantile_cont(ms, 0.99), 3) AS p99"""


def _samples(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    for k, v in NAMES.items():
        kind = F.when(F.col("event_type") == k, v).otherwise(kind)
    return table(spark, d, "events").select(kind.alias("stage"), F.col("value").alias("ms"), "event_id")


@query(f"SELECT event_type AS stage, {_STATS} FROM (SELECT event_type, value AS ms FROM events WHERE value >= 0) GROUP BY 1")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("ms"))
    return L.statistics(L.counted(rows))


_ORDERED = f"""s AS (SELECT stage, {_STATS} FROM x WHERE ms >= 0 GROUP BY 1) SELECT row_number() OVER (ORDER BY CASE stage WHEN 'ocr' THEN 2 WHEN 'parsing' THEN 3 ELSE 9 END, stage) AS place, *, (sum(count) OVER ())::bigint AS total_samples FROM s"""


@query(f"WITH x AS (SELECT {_STAGE} AS stage, value - 10 AS ms FROM events UNION ALL SELECT {_STAGE}, value FROM events WHERE event_id % 3 = 0), {_ORDERED}")
def latency_report(spark: SparkSession, d: str) -> DataFrame:
    """Two recorders merged, negative durations left out, known stages first."""
    rows = _samples(spark, d)
    return L.report(L.counted(L.merged(rows.withColumn("ms", F.col("ms") - 10), rows.where("event_id % 3 = 0"))))


@query(f"WITH x AS (SELECT {_STAGE} AS stage, value AS ms FROM events), {_ORDERED}")
def latency_cumulative(spark: SparkSession, d: str) -> DataFrame:
    """Two runs add their samples to a folder; the report covers both."""
    path, rows = f"{scratch_folder(spark)}/samples", _samples(spark, d)
    empty = L.load(spark, path)
    for run in (0, 1):
        L.save(rows.where(F.col("event_id") % 2 == run), path)
    return L.report(L.counted(L.merged(empty, L.load(spark, path))))


@query(f"""WITH r AS (SELECT event_id % 2 AS run, {_STAGE} AS stage, count(*) AS n, round(avg(value), 3) AS m FROM events GROUP BY ALL), x AS (SELECT stage, m AS ms FROM r, unnest(range(n))), {_ORDERED}""")
def latency_from_reports(spark: SparkSession, d: str) -> DataFrame:
    """Two reports whose samples are gone, merged by their means."""
    rows = _samples(spark, d)
    both = [L.statistics(L.counted(rows.where(F.col("event_id") % 2 == run))) for run in (0, 1)]
    return L.report(L.from_reports(both[0].unionByName(both[1])))
