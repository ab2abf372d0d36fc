"""Shards by jump consistent hashing, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.llm._columns import packed, quoted, unpacked
from quillrank.llm._scratch import Scratch

#: Jumps that are looked at. A key makes ln(shards) jumps on average, 14 at a million shards with a spread of 4; one that
#: made more would stay where its last jump took it, so that the law holds all the same.
MOST_JUMPS = 64


def jump(key: Column, shards: int) -> Column:
    """A struct of the key's shard among `shards`, and among one more.

    Each key has its own sequence of ever larger shard numbers, drawn with xxhash64 of the key and the step: after
    b comes floor((b + 1) / u) with u uniform in (0, 1]. The shard is the last one below the number of shards, so
    with one more shard a key either stays or goes to the new one. No table of shards is kept. A null key has a
    shard like any other.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")

    def step(acc: Column, i: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, i), 11) + 1).cast("double") / F.lit(2.0**53)
        after = F.least((acc["next"] + 1).cast("double") / u, F.lit(float(1 << 52))).cast("long")
        go = acc["next"] <= shards
        return F.struct(
            F.when(acc["next"] < shards, acc["next"]).otherwise(acc["shard"]).alias("shard"),
            F.when(go, acc["next"]).otherwise(acc["grown"]).alias("grown"),
            F.when(go, after).otherwise(acc["next"]).alias("next"),
        )

    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("shard"), zero.alias("grown"), zero.alias("next"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(min(shards + 1, MOST_JUMPS))), start, step)


def assign_shards(df: DataFrame, key: str, shards: int, order: list[str], per_bucket: int = 100_000) -> DataFrame:
    """Add `shard`, `slot` (0, 1, ... in each shard) and `grown_shard` (with one more shard) to every row.

    Slots are numbered in two steps, so that no task holds a whole shard: rows within hash buckets of a shard, then
    buckets by running sums of their counts. There are 1,024 buckets a shard, and more as soon as they would hold over
    `per_bucket` rows each. Equal keys go to one shard, rows with a null key too; rows equal in `key` and `order` take
    neighbouring slots in any order. The rows are written to shared storage once, so that numbering and counting see the
    same ones; keep wide columns out and join them by key where they are needed. Other columns stay, whatever their
    names; ones called shard, slot or grown_shard give way. No rows give none.
    """
    spark, by = df.sparkSession, [f"by_{i}" for i in range(len(order))]
    rows = packed(df, key=quoted(key), **{b: quoted(c) for b, c in zip(by, order, strict=True)}).withColumn("jump", jump(F.col("key"), shards))
    rows = rows.withColumns({"shard": F.col("jump.shard").cast("int"), "grown": F.col("jump.grown").cast("int")}).drop("jump")
    rows = Scratch(spark, "shards").save(rows, "placed")
    buckets = max(1_024, rows.count() // (per_bucket * shards))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit("slot"), "key", *by), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    running = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("before"))
    within = Window.partitionBy("shard", "bucket").orderBy("key", *by)
    numbered = rows.withColumn("at", F.row_number().over(within) - 1).join(before, ["shard", "bucket"])
    return unpacked(numbered, df.columns, shard=F.col("shard"), slot=F.col("at") + F.col("before"), grown_shard=F.col("grown"))
