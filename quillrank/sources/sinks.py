"""Tables written so that a second run leaves the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, key: list[str], version: str) -> DataFrame:
    """Of each key the row of the latest version; of equal ones a new row before an old one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*key).orderBy(F.col(version).desc_nulls_last(), F.col("_new").desc())
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Writes a folder a value of `by`; those that `df` has are replaced whole, others stay as they are."""
    df.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def without(rows: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key isn't among the deleted ones."""
    return rows.join(gone.select(*key).distinct(), key, "left_anti")


def export_csv(df: DataFrame, path: str, by: list) -> None:
    """One ordered set of CSV files with headers; Spark's range partitions keep the order from file to file."""
    df.orderBy(*by).write.mode("overwrite").option("header", "true").csv(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def backfilled(df: DataFrame, column: str, default: str) -> DataFrame:
    """A column that is added, or whose nulls and empty strings get the default."""
    return df.withColumn(column, F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(default)) if column in df.columns else F.lit(default))


def vector_meta(vectors: DataFrame, column: str) -> DataFrame:
    """(dimension, num_vectors) of an index."""
    return vectors.agg(F.max(F.size(column)).cast("long").alias("dimension"), F.count(column).alias("num_vectors"))


def without_cascade(rows: DataFrame, tables: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Rows that aren't deleted, and of each table (with its foreign key) those whose row is not deleted."""
    ids = gone.select(F.col(key).alias("_gone")).distinct()
    left = lambda df, k: df.join(ids, df[k] == ids["_gone"], "left_anti")
    return left(rows, key), {name: left(df, k) for name, (df, k) in tables.items()}


def write_ranking(rows: DataFrame, path: str, job: str, by: list[Column], columns: list[str], mode: str, ranked_at: str, config: dict) -> None:
    """Rankings of the jobs in `rows` in the place of those jobs' earlier ones; other jobs' stay as they are.

    ranking.json has all columns with the rank, the mode, one time and the settings, ranking.csv `columns` with the rank,
    best first, and summary.json a row a job with counts, the best score and the settings. `by` orders a job's rows; its
    last key must tell them apart. A large job is split over tasks by ranges of ranks.
    """
    settings = F.create_map(*(F.lit(x) for kv in config.items() for x in kv))
    stamp = {"mode": F.lit(mode), "ranked_at": F.lit(ranked_at).cast("date"), "weights": settings}
    numbered = rows.withColumn("rank", F.row_number().over(Window.partitionBy(job).orderBy(*by)).cast("long"))
    laid = numbered.repartitionByRange(job, "rank").sortWithinPartitions(job, "rank")

    def put(df: DataFrame, name: str, kind: str, **options: str) -> None:
        df.write.format(kind).mode("overwrite").options(partitionOverwriteMode="dynamic", **options).partitionBy(job).save(f"{path}/{name}")

    put(laid.withColumns(stamp), "ranking.json", "json")
    put(laid.select(job, "rank", *columns), "ranking.csv", "csv", header="true")
    put(rows.groupBy(job).agg(F.count("*").alias("candidates")).withColumns(stamp), "summary.json", "json")


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """Rows whose vector is there and not empty."""
    return vectors.where(F.size(F.coalesce(F.col(column), F.array().cast(vectors.schema[column].dataType))) > 0)


def write_index(vectors: DataFrame, path: str, column: str, by: str, kind: str, built_at: str) -> None:
    """An index a collection (`by`), replaced whole: `vectors` with their file names, and `meta` with a row a collection
    (dimension, num_vectors, type, built_at). Missing and empty vectors are left out."""
    good = usable(vectors, column)
    replace_partitions(good, f"{path}/vectors", by)
    meta = good.groupBy(by).agg(F.max(F.size(column)).cast("long").alias("dimension"), F.count("*").alias("num_vectors"))
    replace_partitions(meta.withColumns({"type": F.lit(kind), "built_at": F.lit(built_at).cast("date")}), f"{path}/meta", by)


def write_vectoriser(index, path: str, settings: dict) -> None:
    """What a vectoriser has learnt, as tables: `vocabulary` (section, term, word, df, idf), `doc_terms` (key, section, term,
    n) and the settings; `index` is an `operators.sections.TermIndex`."""
    index.words().write.mode("overwrite").parquet(f"{path}/vocabulary")
    index.counts.write.mode("overwrite").parquet(f"{path}/doc_terms")
    pairs = F.create_map(*(F.lit(str(x)) for kv in settings.items() for x in kv))
    index.spark.range(1).select(pairs.alias("settings")).write.mode("overwrite").json(f"{path}/settings.json")


def fresh(rows: DataFrame, at: str, now: Column, ttl: str = "INTERVAL 1 HOUR") -> tuple[DataFrame, DataFrame]:
    """Cached rows that are no older than `ttl`, and the expired ones, which go."""
    young = F.coalesce(now - F.col(at) <= F.expr(ttl), F.lit(False))
    return rows.where(young), rows.where(~young)
