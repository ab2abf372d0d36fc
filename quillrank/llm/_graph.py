"""Connected components of links, as joins and grouped minima."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm._scratch import Scratch

#: Parts in which a node's links meet what is known of the node.
PARTS = 64


def _beside(links: DataFrame, least: DataFrame) -> DataFrame:
    """`links` with each `a`'s row of `least`, which goes to each part of the node's links once: no task takes all of a
    node's. Parts that outgrow a task on a large table are split by Spark, as the other side has one row for each."""
    parts = links.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(PARTS)).cast("int"))
    return parts.join(parts.select("a", "part").distinct().join(least, "a"), ["a", "part"])


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) of every node of `links` (a, b): root is the least node that can be reached.

    Alternates two steps: each node's larger neighbours, then its smaller ones, are linked to the least node that it
    knows. Links turn into stars in a number of rounds that grows with the logarithm of the longest path. Minima are
    summed before each shuffle and the joins can be split, so a node with very many links takes no single task; each
    round is written to shared storage. Every round but the last lowers some node's neighbour, so rounds come to an end.
    """
    tidy = lambda df: df.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = scratch.save(tidy(links), f"{name}-0")
    was = None
    for i in count(1):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        up = tidy(_beside(both.where("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b")))
        up = scratch.save(up, f"{name}-{i}-up")
        low = up.groupBy("a").agg(F.min("b").alias("m"))
        down = _beside(up, low).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        now = scratch.save(tidy(down), f"{name}-{i}")
        seen = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        scratch.drop(f"{name}-{i}-up")
        scratch.drop(f"{name}-{i - 1}")
        if seen == was:
            break
        was = seen
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
