"""Where queries and the SQL beside them are registered. It imports no plan, so that plans can be imported in any order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str, each: int = 5_000) -> DataFrame:
    """Rows dealt by key, about `each` to a task: a small file of rows that cost much is no single task's."""
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // each)
    return rows.repartition(parts, key)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its SQL if there is some."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add
