"""Similarity, scores and ranks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from quillrank.config import RankingConfig, checked_weights


def overlap(wanted: Column, own: Column) -> Column:
    """Share of the wanted skills that are there; 0 if none is wanted."""
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, own)) / F.size(wanted)).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    n = F.size(F.array_union(a, b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(0.0)


def explained(wanted: Column, own: Column) -> list[Column]:
    return [F.array_sort(F.array_intersect(wanted, own)).alias("matched"), F.array_sort(F.array_except(wanted, own)).alias("missing")]


def covered(missing: Column, own: Column, implied: Column) -> Column:
    """Missing skills that skills of one's own imply, each with those: (skill, covered_by)."""
    by = F.transform(missing, lambda s: F.struct(s.alias("skill"), F.array_sort(F.array_intersect(F.coalesce(F.try_element_at(implied, s), F.array().cast("array<string>")), own)).alias("covered_by")))
    return F.filter(by, lambda x: F.size(x["covered_by"]) > 0)


def contextual(wanted: Column, own: Column, cover: Column, part: float = 0.6) -> Column:
    n = F.size(F.array_intersect(wanted, own)) + part * F.size(cover)
    return F.when(F.size(wanted) > 0, F.least(F.lit(1.0), n / F.size(wanted))).otherwise(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def ranked(df: DataFrame, by: list[Column], within: list[str], name: str = "rank") -> DataFrame:
    """1, 2, 3, ... in the order given within each job or other group; the last key must tell rows apart."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(*by)).cast("long"))


def final_score(cfg: RankingConfig) -> Column:
    """Weighted score, or 0 where a hard limit isn't met."""
    w = cfg.weights
    total = w["semantic"] * F.col("semantic") + w["skill_match"] * F.col("skill") + w["experience"] * F.col("experience") + w["education"] * F.col("education")
    return F.when(F.col("passed"), total).otherwise(0.0)


def scored(df: DataFrame, cfg: RankingConfig, key: str, job: str = "job") -> DataFrame:
    """Adds passed, rounded scores, the final score from unrounded ones, and each job's ranks by it.

    `df` has `job`, `key`, semantic, skill, experience, education and years. Candidates below a limit stay, with 0.
    """
    passed = (F.col("skill") >= cfg.min_skill_overlap) & (F.col("years") >= cfg.min_experience_years)
    out = df.withColumn("passed", passed).withColumn("final", F.round(final_score(cfg), 4))
    out = out.withColumns({c: F.round(c, 4) for c in ("semantic", "skill", "experience", "education")})
    return ranked(out, [F.col("final").desc(), F.col(key)], [job], "rank_position")


def reranked(rankings: DataFrame, weights: dict, key: str, job: str = "job") -> DataFrame:
    """New ranks from stored, rounded scores; nulls count as 0."""
    w = checked_weights(weights)
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("semantic", "skill", "experience", "education")}
    out = rankings.drop("rank_position").withColumns(zero).withColumn("final", F.round(final_score(RankingConfig(w)), 4))
    return ranked(out, [F.col("final").desc(), F.col(key)], [job], "rank_position")


def units(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows of unit length, in double precision; zeros stay."""
    x = np.array(column.to_pylist(), dtype=np.float64)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def met_in_blocks(rows: DataFrame, others: DataFrame, key: str, columns: list[str], block: int, other_block: int) -> GroupedData:
    """Blocks of `rows` beside blocks of `others` (`key` and `columns` both; side 0 and 1), each pair of blocks a group, so
    that all meet all and neither side is sent whole to a task."""
    of = lambda df, size: max(1, -(-df.count() // size))
    n, m = of(rows, block), of(others, other_block)
    pick = lambda k, salt: F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = rows.select(F.lit(0).alias("side"), key, *columns, pick(n, "rows").alias("r"), every(m).alias("s"))
    right = others.select(F.lit(1).alias("side"), key, *columns, every(n).alias("r"), pick(m, "others").alias("s"))
    return left.unionByName(right).groupBy("r", "s")


def usable(vec: Column) -> Column:
    """Whether a vector has components, none of them null, and isn't zero."""
    return F.coalesce(F.forall(vec, lambda x: x.isNotNull()) & F.exists(vec, lambda x: x != 0), F.lit(False))


def semantic(wanted: DataFrame, chunks: DataFrame, best: int = 3) -> DataFrame:
    """(candidate, semantic, top): mean of a candidate's best chunks by their largest cosine with a wanted chunk.

    Blocks of `chunks` (candidate, chunk_idx, vec) meet blocks of `wanted` (w_id, w_vec), a description's chunks; a row a
    chunk and block of wanted ones is shuffled again. Vectors that are null, zero or hold nulls are left out.
    """

    def most(group: pa.Table) -> pa.Table:
        own, asked = (group.filter(pc.equal(group["side"], s)) for s in (0, 1))
        cos = (units(own["vec"]) @ units(asked["vec"]).T).max(axis=1) if len(own) and len(asked) else np.empty(0)
        id = own["id"].combine_chunks()[: len(cos)]
        return pa.table({"candidate": id.field("candidate"), "chunk_idx": id.field("chunk_idx"), "cos": pa.array(cos, pa.float64())})

    vec = lambda c: F.col(c).cast("array<double>").alias("vec")
    own = chunks.select(F.struct(F.col("candidate").cast("long").alias("candidate"), F.col("chunk_idx").cast("long").alias("chunk_idx")).alias("id"), vec("vec"))
    asked = wanted.select(F.struct(F.lit(None).cast("long").alias("candidate"), F.col("w_id").cast("long").alias("chunk_idx")).alias("id"), vec("w_vec"))
    met = met_in_blocks(own.where(usable(F.col("vec"))), asked.where(usable(F.col("vec"))), "id", ["vec"], 8_192, 1_024)
    near = met.applyInArrow(most, "candidate long, chunk_idx long, cos double").groupBy("candidate", "chunk_idx").agg(F.max("cos").alias("cos"))
    w = Window.partitionBy("candidate").orderBy(F.col("cos").desc(), F.col("chunk_idx").desc())
    top = near.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= best)
    return top.groupBy("candidate").agg(F.avg("cos").alias("semantic"), F.transform(F.array_sort(F.collect_list(F.struct("nth", "chunk_idx"))), lambda x: x["chunk_idx"]).alias("top"))


def nearest_l2(vectors: DataFrame, queries: DataFrame, k: int, block: int = 8_192) -> DataFrame:
    """The k vectors (id, vec) nearest to each of `queries` (q, q_vec) by squared distance of unit vectors, with similarity
    1 / (1 + d); of equal ones those with the least id. Vectors that are null, zero or hold nulls are left out.

    Blocks of vectors meet blocks of queries in matrix products; of each only the k best of a query are shuffled again.
    """

    def best(group: pa.Table) -> pa.Table:
        own, asked = (group.filter(pc.equal(group["side"], s)).sort_by("id") for s in (0, 1))
        out: tuple[list, list, list] = ([], [], [])
        if len(own) and len(asked):
            ids, x, q = np.array(own["id"]), units(own["vec"]), np.array(asked["id"])
            for lo in range(0, len(q), 256):
                d2 = np.round(np.maximum(2 - 2 * units(asked["vec"].slice(lo, 256)) @ x.T, 0), 6)
                near = np.argsort(d2, axis=1, kind="stable")[:, :k]
                for part, values in zip(out, (np.repeat(q[lo : lo + 256], near.shape[1]), ids[near].ravel(), np.take_along_axis(d2, near, axis=1).ravel()), strict=True):
                    part.append(values)
        empty = (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0))
        return pa.table(dict(zip(("q", "id", "d2"), (np.concatenate([*v, e]) for v, e in zip(out, empty, strict=True)), strict=True)))

    good = lambda df, key, vec: df.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec")).where(usable(F.col("vec")))
    near = met_in_blocks(good(vectors, "id", "vec"), good(queries, "q", "q_vec"), "id", ["vec"], block, 1_024).applyInArrow(best, "q long, id long, d2 double")
    nth = F.row_number().over(Window.partitionBy("q").orderBy("d2", "id"))
    return near.withColumn("_n", nth).where(F.col("_n") <= k).select("q", "id", "d2", F.round(1 / (1 + F.col("d2")), 4).alias("similarity"))


def exceptional(answer: Column, contexts: Column, watched: list[str]) -> Column:
    """Watched terms that the answer holds and its contexts don't, in either case."""
    low, known = F.lower(answer), F.lower(F.coalesce(contexts, F.lit("")))
    return F.filter(F.array(*map(F.lit, watched)), lambda t: F.contains(low, t) & ~F.contains(known, t))


def not_retrieved(answer: Column, expected: Column, retrieved: Column) -> Column:
    """Expected files that the lower-cased answer names without their suffix although they weren't retrieved."""
    stem = lambda r: F.replace(F.replace(r, F.lit(".txt")), F.lit(".pdf"))
    return F.filter(expected, lambda r: F.contains(F.lower(answer), stem(r)) & ~F.array_contains(retrieved, r))


def education(tier: Column) -> Column:
    return tier / 4.0


def combined(similarity: Column, skill: Column, ranking: Column | None = None) -> Column:
    """A hit's score: with its earlier ranking's score if there was a ranking, else of similarity and skills alone."""
    return 0.6 * similarity + 0.4 * skill if ranking is None else 0.4 * similarity + 0.3 * ranking + 0.3 * skill


def retrieved(rank: Column, score: Column, skills: Column, least_rank: int | None = None, most_rank: int | None = None, least_score: float | None = None, required: list[str] | None = None) -> Column:
    """Whether a hit passes the filters that are set: ranked at least and at most so well, scored so high, and with any of
    the required skills."""
    fine = F.lit(True)
    if least_rank is not None:
        fine &= rank <= least_rank
    if most_rank is not None:
        fine &= rank >= most_rank
    if least_score is not None:
        fine &= score >= least_score
    if required:
        fine &= F.arrays_overlap(skills, F.array(*(F.lit(s.lower()) for s in required)))
    return fine
