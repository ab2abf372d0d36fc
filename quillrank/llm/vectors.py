"""Near-duplicate embeddings over coarse inverted lists with product-quantised residuals."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.llm._graph import components
from quillrank.llm._scratch import Scratch

#: Vectors a list that the quantiser is fitted on, and in all at most: rows with the least hash of their id.
PER_LIST, SAMPLE = 64, 65_536
#: Lists at most. Up to 67 million rows of one label, lists grow in number as their rows do.
MOST_LISTS = 8_192
#: Vectors of a list, and queries to it, that meet in one task are about this many each.
BLOCK = 1_024
_ROW = "uid long, vec_id long, label int, dim int, unit binary, cell int, codes binary, err float, probes array<int>"


@dataclass
class Quantiser:
    """Unit centroids of the lists, and the codebooks of the residuals' subspaces."""

    cells: np.ndarray
    books: np.ndarray

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For unit vectors: list, codes, distance to what the codes stand for, and similarity to each centroid."""
        near = x @ self.cells.T
        cell = near.argmax(axis=1)
        left = x - self.cells[cell]
        m, _, d = self.books.shape
        codes, back = np.empty((len(x), m), dtype=np.uint8), np.empty_like(left)
        for i in range(m):
            part = left[:, i * d : (i + 1) * d]
            gap = (self.books[i] ** 2).sum(axis=1) - 2 * part @ self.books[i].T
            codes[:, i] = gap.argmin(axis=1)
            back[:, i * d : (i + 1) * d] = self.books[i][codes[:, i]]
        return cell, codes, np.linalg.norm(left - back, axis=1), near

    def probes(self, cell: np.ndarray, near: np.ndarray, least: float) -> np.ndarray:
        """Which lists hold what may be similar: see `near_duplicates`."""
        apart = np.sqrt(np.maximum(2 - 2 * self.cells[cell] @ self.cells.T, 1e-12))
        side = (near[np.arange(len(cell)), cell][:, None] - near) / apart
        return side <= np.sqrt((1 - least) / 2) + 1e-9


def _means(x: np.ndarray, k: int, unit: bool, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        at = ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        full = n > 0
        centres[full] = sums[full] / n[full, None]
        if unit:
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def fit(sample: np.ndarray, cells: int, parts: int = 8, words: int = 64, seed: int = 11) -> Quantiser:
    rng, d = np.random.default_rng(seed), sample.shape[1]
    parts = next(p for p in range(min(parts, d), 0, -1) if d % p == 0)
    centres = _means(sample, min(cells, len(sample)), True, rng)
    left = sample - centres[(sample @ centres.T).argmax(axis=1)]
    books = np.stack([_means(left[:, i * d // parts : (i + 1) * d // parts], words, False, rng) for i in range(parts)])
    return Quantiser(centres, books)


def _units(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors: the rows, and their unit vectors in double precision. Null or empty ones, zeros and
    those that hold what isn't finite are left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets, valid = np.array(column.offsets), np.array(column.is_valid())
    flat = np.array(column.values.cast(pa.float64()).fill_null(np.nan))
    sizes = np.where(valid, np.diff(offsets), 0)
    for d in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == d)
        x = flat[offsets[:-1][rows][:, None] + np.arange(d)]
        most = np.abs(x).max(axis=1)
        good = np.isfinite(most) & (most > 0)
        # the largest component becomes 1 first, so that squares neither overflow nor vanish
        x = x[good] / most[good][:, None]
        yield rows[good], x / np.sqrt((x * x).sum(axis=1))[:, None]


def _encode(qs: dict[int, Quantiser], least: float):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, unit in _units(b["embedding"]):
                q = qs.get(unit.shape[1])
                for lo in range(0, len(rows), 256):
                    x = unit[lo : lo + 256]
                    cell, codes, err, probes = np.full(len(x), -1), [b""] * len(x), np.zeros(len(x)), [[-1]] * len(x)
                    if q:
                        cell, code, err, near = q.encode(x)
                        codes, err = [c.tobytes() for c in code], err + 1e-5
                        probes = [np.flatnonzero(p).tolist() for p in q.probes(cell, near, least)]
                    take = pa.array(rows[lo : lo + 256], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [*(b[c].take(take) for c in ("uid", "vec_id", "label")), pa.array(np.full(len(x), x.shape[1]), pa.int32()), pa.array([v.tobytes() for v in x], pa.binary()),
                         pa.array(cell, pa.int32()), pa.array(codes, pa.binary()), pa.array(err.astype(np.float32), pa.float32()), pa.array(probes, pa.list_(pa.int32()))],
                        names=["uid", "vec_id", "label", "dim", "unit", "cell", "codes", "err", "probes"],
                    )

    return encode


def _search(qs: dict[int, Quantiser], least: float):
    """A block of queries against a block of a list: table-lookup distances, then the exact cosine of what is near.

    Returns a row (a, null, n) for each vector with links that are counted here, and rows (a, b, 0) that join all that
    is linked here: one for each vector, to the least of its group, not one for each link. A link is counted for the
    query; for the other end only if that doesn't look into the query's own list, where it would count the link as a
    query itself. So each link that either end finds is counted once for both.
    """
    reach = np.sqrt(2 - 2 * least) + 1e-5

    def search(group: pa.Table) -> pa.Table:
        cell, dim = group["cell"][0].as_py(), group["dim"][0].as_py()
        q, home = qs.get(dim), np.array(group["home"])
        ask = np.array(group["ask"].to_pylist())
        uid, vec = np.array(group["uid"]), group["vec_id"].combine_chunks()
        vec, known = np.array(vec.fill_null(0)), np.array(vec.is_valid())
        unit = np.frombuffer(b"".join(group["unit"].to_pylist()), dtype=np.float64).reshape(-1, dim)
        ask, own = np.flatnonzero(ask), np.flatnonzero(~ask)
        links = np.zeros((len(ask), len(own)), dtype=bool)
        if len(own) and len(ask):
            if cell >= 0:
                m, words, d = q.books.shape
                codes = np.frombuffer(b"".join(group["codes"].take(pa.array(own)).to_pylist()), dtype=np.uint8).reshape(-1, m).astype(np.int64)
                err = np.array(group["err"])[own]
            for lo in range(0, len(ask), 128):
                x = unit[ask[lo : lo + 128]]
                if cell >= 0:
                    left = (x - q.cells[cell]).reshape(len(x), m, d)
                    table = ((left[:, :, None, :] - q.books[None]) ** 2).sum(axis=3)
                    far = np.zeros((len(x), len(own)))
                    for i in range(m):
                        far += table[:, i, :][:, codes[:, i]]
                    near = np.sqrt(far) - err[None, :] <= reach
                else:
                    near = np.ones((len(x), len(own)), dtype=bool)
                some = np.flatnonzero(near.any(axis=0))
                cos = x @ unit[own[some]].T
                links[lo : lo + 128, some] = near[:, some] & (cos >= least)
            links &= ~((vec[ask][:, None] == vec[own][None, :]) & known[ask][:, None] & known[own][None, :])
            links &= uid[ask][:, None] != uid[own][None, :]
        rows, cols = np.flatnonzero(links.any(axis=1)), np.flatnonzero(links.any(axis=0))
        asked, of = home[ask[rows]], group["probes"].take(pa.array(own[cols])).to_pylist()
        told = np.array([np.isin(asked, p) for p in of], dtype=bool).reshape(len(cols), len(rows)).T
        counted = np.concatenate([links[rows].sum(axis=1), (links[np.ix_(rows, cols)] & ~told).sum(axis=0)])
        who = np.concatenate([uid[ask[rows]], uid[own[cols]]])[counted > 0]
        counted = counted[counted > 0]
        a, b = uid[ask[rows]].copy(), uid[own[cols]].copy()
        if len(rows):
            part = links[np.ix_(rows, cols)]
            top = np.iinfo(np.int64).max
            while True:
                a2 = np.minimum(a, np.where(part, b[None, :], top).min(axis=1))
                b2 = np.minimum(b, np.where(part, a2[:, None], top).min(axis=0))
                if (a2 == a).all() and (b2 == b).all():
                    break
                a, b = a2, b2
        left, root = np.concatenate([uid[ask[rows]], uid[own[cols]]]), np.concatenate([a, b])
        left, root = left[left != root], root[left != root]
        return pa.table({
            "a": pa.array(np.concatenate([who, left]), pa.int64()),
            "b": pa.concat_arrays([pa.nulls(len(who), pa.int64()), pa.array(root, pa.int64())]),
            "n": pa.array(np.concatenate([counted, np.zeros(len(left), dtype=np.int64)]), pa.int64()),
        })

    return search


def _blocks(n: Column) -> Column:
    return F.ceil(n / BLOCK).cast("int")


def links(rows: DataFrame, qs: dict[int, Quantiser], least: float, scratch: Scratch) -> DataFrame:
    """(a, b, n) as `_search` gives them, for all pairs of `rows` (uid, vec_id, label, embedding) of equal labels."""
    coded = scratch.save(rows.where("label IS NOT NULL").mapInArrow(_encode(qs, least), _ROW), "coded")
    at = ["label", "dim", "cell"]
    asks = coded.select("label", "dim", F.explode("probes").alias("cell")).groupBy(*at).agg(F.count("*").alias("asks"))
    size = scratch.save(coded.groupBy(*at).agg(F.count("*").alias("held")).join(asks, at), "size")
    pick = lambda n, salt: F.pmod(F.xxhash64("uid", F.lit(salt)), n).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    held = coded.withColumn("home", F.col("cell")).join(size, at).withColumn("own", pick(_blocks(F.col("held")), "own"))
    held = held.withColumn("ask_block", spread(_blocks(F.col("asks")))).withColumn("ask", F.lit(False))
    asking = coded.withColumnRenamed("cell", "home").withColumn("cell", F.explode("probes")).join(size, at).withColumn("ask_block", pick(_blocks(F.col("asks")), "ask"))
    asking = asking.withColumns({"codes": F.lit(None).cast("binary"), "probes": F.lit(None).cast("array<int>"), "own": spread(_blocks(F.col("held")))}).withColumn("ask", F.lit(True))
    both = held.unionByName(asking).drop("held", "asks")
    return both.groupBy(*at, "own", "ask_block").applyInArrow(_search(qs, least), "a long, b long, n long")


def near_duplicates(embeddings: DataFrame, least: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of `embeddings` (vec_id, embedding, label; other columns
    are left out).

    Only rows with equal labels, not null, are compared. Lists are unit centroids, about the square root of the rows of
    the most frequent label (MOST_LISTS at most), for each length of vectors, fitted on PER_LIST vectors a list and
    SAMPLE at most; every row is then put into its list. Table lookups give the distance to a list's coded vectors;
    one is left out only if, less the vector's own coding error, it is beyond what the least cosine allows, so the codes
    lose nothing; the rest is decided by the exact cosine in double precision. Lists and their queries meet in blocks,
    however full a list is.

    Probes lose no link, in any number of dimensions: two vectors in different lists lie on either side of the plane halfway
    between the centroids, so their distances to it add up to no more than the distance between them, which for a link is
    sqrt(2 - 2 * least) at most. One of the two is then within half of that, sqrt((1 - least) / 2), and every vector probes
    the lists to whose plane it is as near as that. Links that one end finds count for both.

    A vector that is null, empty, zero or holds null or non-finite components is linked with nothing, and so is a row
    without label. Equal rows are one vector with a row each; rows with one vec_id aren't linked with each other. Of
    vectors whose length the sample lacks, each is compared with all others of its label and length.
    """
    spark, scratch = embeddings.sparkSession, Scratch(embeddings.sparkSession, "vectors")
    rows = scratch.save(embeddings.select("vec_id", "embedding", "label", F.xxhash64("vec_id", "label", "embedding").alias("uid")), "rows")
    once = scratch.save(rows.dropDuplicates(["uid"]), "once")
    most = once.where("label IS NOT NULL").groupBy("label").count().agg(F.max("count")).first()[0] or 0
    lists = max(1, min(MOST_LISTS, int(most**0.5)))
    sample = once.where("label IS NOT NULL").orderBy(F.xxhash64("vec_id"), "uid").select("embedding").limit(min(SAMPLE, max(1_024, PER_LIST * lists)))
    qs = {x.shape[1]: fit(x, lists) for _, x in _units(sample.toArrow()["embedding"]) if len(x)} if most else {}
    found = scratch.save(links(once, qs, least, scratch), "found")
    degree = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("n_links")).withColumnRenamed("a", "uid")
    roots = components(found.where("b IS NOT NULL").select("a", "b"), scratch, "components").withColumnRenamed("node", "uid")
    named = scratch.save(rows.select("uid", "vec_id").join(roots, "uid", "left").join(degree, "uid", "left").select("uid", "vec_id", F.coalesce("root", "uid").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("root").isNotNull().alias("linked")), "named")
    first = named.where("linked").groupBy("root").agg(F.min("vec_id").alias("least_id"))
    out = named.join(first, "root", "left")
    component = F.when(F.col("linked"), F.col("least_id")).otherwise(F.col("vec_id"))
    return scratch.last(out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept")))
