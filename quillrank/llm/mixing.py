"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrank.llm._columns import packed, quoted, unpacked
from quillrank.llm._scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Blocks that all sources' draws make up together, at most about this many: the tree's draws stay exact and small.
BLOCKS = 1 << 20
#: Blocks that a source's own draws make up, at least, unless a block is one word: a small source is dealt out too.
LEAST_BLOCKS = 1_024
#: All small sources' blocks together are about twice this many at most; the draws take no more than 10^9.
FINE_BLOCKS = 1 << 28
#: Sources whose quotas the driver plans, a row each; more are refused, not dropped.
MOST_SOURCES = 1_000_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[int], share: float, most: float) -> list[float]:
    """Split share x all sizes by weight, none above most x its size; what is above is shared anew by weight.

    The level at which sources fill up is found in order of how soon they do: with the k soonest full, the rest get
    (total - what the full ones hold) / (their weights) for each unit of weight.
    """
    total = share * sum(sizes)
    soonest = sorted(range(len(sizes)), key=lambda i: most * sizes[i] / weights[i])
    full, weight, level = 0.0, sum(weights), 0.0
    for i in soonest:
        level = (total - full) / weight
        if most * sizes[i] / weights[i] >= level:
            break
        full, weight = full + most * sizes[i], weight - weights[i]
    return [float(min(most * s, level * w)) for s, w in zip(sizes, weights, strict=True)]


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks of each source (columns) for each shard (rows), summing exactly to the quotas.

    Shards are halved again and again; at each node the left half's blocks are one multivariate-hypergeometric draw
    from the node's, which is what dealing out one well shuffled deck would give. The seed of a node is its path, so
    any node can be drawn again alone.
    """
    out = np.zeros((shards, len(quotas)), dtype=np.int64)
    total = int(quotas.sum())
    cuts = [total * i // shards for i in range(shards + 1)]
    todo = [(0, shards, quotas.astype(np.int64))]
    while todo:
        a, b, q = todo.pop()
        if b - a == 1:
            out[a] = q
            continue
        mid = (a + b) // 2
        rng = np.random.default_rng([seed, a, b])
        left = rng.multivariate_hypergeometric(q, cuts[mid] - cuts[a], method="marginals") if len(q) else q
        todo += [(a, mid, left), (mid, b, q - left)]
    return out


@dataclass
class Plan:
    """What each source gives: rows of (key, index, size, target, block, blocks, quota, cuts)."""

    rows: list[tuple]
    schema = T.StructType(
        [
            T.StructField("_source", T.StringType()),
            T.StructField("source_size", T.LongType()),
            T.StructField("target", T.DoubleType()),
            T.StructField("_block", T.LongType()),
            T.StructField("_blocks", T.LongType()),
            T.StructField("_quota", T.LongType()),
            T.StructField("_cuts", T.ArrayType(T.LongType())),
        ]
    )


def block_words(target: float, total: int, sources: int) -> int:
    """Words in a block of a source: all targets' share of BLOCKS, halved until the source's own has LEAST_BLOCKS."""
    block, least = max(1, total // BLOCKS), min(LEAST_BLOCKS, max(1, FINE_BLOCKS // sources))
    while block > 1 and target < least * block:
        block //= 2
    return block


def plan(sizes: dict[str | None, int], weights: list[int], share: float, most: float, shards: int, seed: int) -> Plan:
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    size = [sizes[s] for s in names]
    want = targets(size, [weights[i % len(weights)] for i in range(len(names))], share, most) if names else []
    block = [block_words(t, int(sum(want)), len(names)) for t in want]
    blocks = [-(-s // b) for s, b in zip(size, block, strict=True)]
    quota = []
    for s, t, b, n in zip(size, want, block, blocks, strict=True):
        whole = min(int(most), int(t // s)) if s else 0
        quota.append(min(int(most) * n, whole * n + math.ceil((t - whole * s) / b)))
    cuts = np.zeros((shards, len(names)), dtype=np.int64)
    # sources with blocks of one size are a deck of their own, so that shards get equal words, not only equal blocks
    for b in sorted(set(block)):
        at = [i for i, x in enumerate(block) if x == b]
        cuts[:, at] = np.cumsum(split_quotas(np.array([quota[i] for i in at], dtype=np.int64), shards, seed + b - 1), axis=0)
    return Plan([(s, size[i], want[i], block[i], blocks[i], quota[i], [int(x) for x in cuts[:-1, i]]) for i, s in enumerate(names)])


def _placed(docs: DataFrame, weights: list[int], share: float, most: float, shards: int, seed: int, carry: tuple[str, ...]) -> tuple[DataFrame, int]:
    """What `mix` returns, and the words of all documents."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "mix")
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f"|{seed}")))
    base = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), digest.alias("_h"), F.xxhash64("text").alias("_t"), *carry)
    base = scratch.save(base, "base")
    found = base.groupBy("source").agg(F.sum("size").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    planned = spark.createDataFrame(plan({r["source"]: r["n"] for r in found}, weights, share, most, shards, seed).rows, Plan.schema)
    # 4,096 hash ranges a source, and more on tables whose ranges would hold over 2 ** 20 rows of a source with all rows
    digits = next(k for k in range(3, 9) if base.count() >> (4 * k) < 1 << 20)
    base = base.withColumn("_part", F.substring("_h", 1, digits))
    parts = base.groupBy("source", "_part").agg(F.sum("size").alias("_n"))
    before = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(F.col("source").alias("_s"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    line = Window.partitionBy("source", "_part").orderBy("_h", "doc_id", "size", "_t", *carry).rowsBetween(Window.unboundedPreceding, -1)
    placed = base.withColumn("_at", F.coalesce(F.sum("size").over(line), F.lit(0)))
    placed = placed.join(offsets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p")))
    placed = placed.join(planned, F.col("source").eqNullSafe(F.col("_source")))
    middle = 2 * (F.col("_before") + F.col("_at")) + F.col("size")
    placed = placed.withColumn("_middle", middle).withColumn("_k", F.least(F.call_function("div", "_middle", 2 * F.col("_block")), F.col("_blocks") - 1))
    # a block is drawn if the tree has dealt it to a shard; of the last block, what lies before the target
    draws = F.filter(
        F.array(*(F.struct(F.lit(e).alias("epoch"), (F.col("_k") + e * F.col("_blocks")).alias("draw")) for e in range(int(most)))),
        lambda d: (d["draw"] < F.col("_quota")) & (F.col("_middle") + 2 * d["epoch"] * F.col("source_size") < 2 * F.col("target")),
    )
    dealt = F.transform(
        draws,
        lambda d: F.struct(
            d["epoch"].alias("epoch"),
            F.size(F.filter(F.col("_cuts"), lambda c: c <= d["draw"])).alias("shard"),
            F.xxhash64(F.col("_h"), F.col("_t"), d["epoch"], F.lit(seed)).alias("at"),
        ),
    )
    return placed.select("doc_id", "source", "size", "source_size", "target", dealt.alias("draws"), *carry), sum(r["n"] for r in found)


def mix(docs: DataFrame, weights: list[int], share: float = 1.5, most: float = 2.0, shards: int = 64, seed: int = 7, carry: tuple[str, ...] = ()) -> DataFrame:
    """Draw each source's target from its documents and deal the draws out to output shards.

    `docs` has doc_id, text, source; of more columns only those in `carry` are carried, whose names must not be among
    the result's. A document's size is its number of words, 0 for a null or empty text; a null source is a source of its
    own, last in order. Weights repeat over the sources in code-point order. Returns doc_id, source, size, source_size,
    target and draws: an array of (epoch, shard, at), one for each time that the mix takes the document whole. No rows
    give none.

    A source's documents stand in a line, in order of a seeded digest; those whose middle lies before the target are
    drawn, the line a second time after the first is done, never a third. So the words that a source gives are off
    from its target by half a document at most, however small it is beside the others. The line is cut into blocks of
    equal words, and a document belongs to the block with its middle. The tree deals the drawn blocks to shards; `at` is
    the order within a shard. The line's positions are found by sums over hash ranges of each source and then within each
    range, so a hot source is spread like any other. Repeated rows are documents of their own. The driver holds one row a
    source.
    """
    return _placed(docs, weights, share, most, shards, seed, carry)[0]


def materialise(docs: DataFrame, weights: list[int], share: float = 1.5, most: float = 2.0, shards: int = 64, seed: int = 7, name: str | None = "shard") -> DataFrame:
    """The mix itself: whole rows of `docs`, as often as drawn, by shard and shuffled within each, with the shard's
    number under `name`, before which a column of the caller's so called gives way.

    Rows meet their draws by two 64-bit hashes of all their columns (maps don't count), so ids may be null or repeated:
    of m equal rows one goes on, as often as all m are drawn. A shard is cut by the leading bits of `at` into parts of
    some 2^25 words, each sorted in a task of its own: parts one after another are the shard in its order, whatever its
    size.
    """
    plain = [c for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()]
    rows = packed(docs, doc_id=F.col("doc_id"), source=F.col("source"), text=F.col("text"), k1=F.xxhash64(*map(quoted, plain)), k2=F.xxhash64(F.lit(1), *map(quoted, plain)))
    mixed, words = _placed(rows, weights, share, most, shards, seed, ("k1", "k2"))
    drawn = mixed.select("k1", "k2", F.explode("draws").alias("d")).select("k1", "k2", F.col("d.shard").alias("shard"), F.col("d.at").alias("at"))
    bits = max(0, (int(words * share) // (shards << 25)).bit_length())
    once = rows.groupBy("k1", "k2").agg(F.first("row").alias("row"))
    part = F.shiftrightunsigned("at", 64 - bits) if bits else F.lit(0).cast("long")
    # signed order would begin in the middle of the unsigned parts
    key = F.col("at").bitwiseXOR(F.lit(-(1 << 63)))
    out = once.join(drawn, ["k1", "k2"]).withColumns({"part": (F.col("shard") * (1 << bits) + part).cast("int"), "key": key})
    out = out.repartitionById(shards << bits, F.col("part")).sortWithinPartitions("part", "key")
    return unpacked(out, docs.columns, **({name: F.col("shard")} if name else {}))
