"""Near duplicates by banded MinHash, with odd sketches to estimate the similarity of candidates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrank.llm import _words as W
from quillrank.llm._columns import packed, unpacked
from quillrank.llm._graph import components
from quillrank.llm._scratch import Scratch

#: Bits of an odd sketch.
BITS = 512
#: Documents of a bucket that meet in one task, and bytes of their texts, are about twice this much at most.
BLOCK, BLOCK_BYTES = 512, 2 << 20
#: Members of a bucket that meet their leader in one part, about.
STAR = 128


@dataclass(frozen=True)
class Near:
    """Shingle length, least similarity in per cent, and the bands.

    A link at the least similarity s shares a band with probability 1 - (1 - s^rows)^bands: it is missed about three
    times in 10 million at the default (0.85, 6 x 32). `slack` is how far below s a sketch's estimate may lie for a
    pair to be confirmed on its full sets: over five standard deviations at s.
    """

    shingle: int = 3
    percent: int = 85
    rows: int = 6
    bands: int = 32
    slack: float = 0.15

    @property
    def samples(self) -> int:
        return self.rows * self.bands


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(99)
    return rng.integers(0, 1 << 63, n, dtype=W.U) * W.U(2) + W.U(1), rng.integers(0, 1 << 63, n, dtype=W.U)


def _least(h: np.ndarray, bounds: np.ndarray, p: Near) -> np.ndarray:
    """MinHash samples (one row a hash function, one column a document) of documents none of which is empty."""
    mul, add = _multipliers(p.samples)
    out = np.empty((p.samples, len(bounds) - 1), dtype=W.U)
    x = np.empty_like(h)
    for i in range(p.samples):
        np.multiply(h, mul[i], out=x)
        x += add[i]
        out[i] = np.minimum.reduceat(x, bounds[:-1])
    return out


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """Each document's samples folded into a bitmap: every (sample, value) flips the bit that it hashes to."""
    k, n = least.shape
    bit = W.mix(least + (np.arange(k, dtype=W.U) * W.U(0xC2B2AE3D27D4EB4F))[:, None]) % W.U(BITS)
    at = (np.arange(n, dtype=W.U)[None, :] * W.U(BITS) + bit).astype(np.int64).ravel()
    flips = np.bincount(at, minlength=n * BITS).astype(np.uint8).reshape(n, BITS) & 1
    return np.packbits(flips, axis=1, bitorder="little").view("<i8")


def set_names(h: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """128-bit names of sets: equal sets, and only they, have equal names."""
    parts = [np.add.reduceat(W.mix(h * W.U(c)), bounds[:-1]) for c in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)]
    return [a.tobytes() for a in np.stack(parts, axis=1).astype(">u8")]


def text_names(column: pa.Array, n: int) -> list[bytes | None]:
    """The name of each text's set of n-word shingles; None if it is empty."""
    out: list = []
    for t in W.texts(column):
        h, bounds = W.sets(*t.words(), n)
        full = np.flatnonzero(np.diff(bounds) > 0)
        own = np.full(len(bounds) - 1, None, dtype=object)
        if len(full):
            for i, x in zip(full, set_names(h, np.append(bounds[:-1][full], len(h))), strict=True):
                own[i] = x
        out += list(own)
    return out


def _sketches(p: Near):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in W.texts(b["text"]):
                h, bounds = W.sets(*t.words(), p.shingle)
                n = np.diff(bounds)
                full = np.flatnonzero(n > 0)
                edges = np.append(bounds[:-1][full], len(h))
                name = np.full(len(n), None, dtype=object)
                bands = np.full(len(n), None, dtype=object)
                odd = np.full(len(n), None, dtype=object)
                if len(full):
                    least = _least(h, edges, p)
                    sets, sketch = set_names(h, edges), odd_sketch(least)
                    band = np.empty((p.bands, len(full)), dtype=W.U)
                    for i in range(p.bands):
                        x = W.mix(least[i * p.rows] + W.U(i))
                        for j in range(1, p.rows):
                            x = W.chain(x, least[i * p.rows + j])
                        band[i] = x
                    for at, i in enumerate(full):
                        name[i], bands[i], odd[i] = sets[at], band[:, at].view(np.int64), sketch[at]
                yield pa.RecordBatch.from_arrays(
                    [b["doc_id"].slice(t.rows.start, len(n)), pa.array(n, pa.int64()), pa.array(np.diff(t.bounds), pa.int64()), pa.array(name, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "bytes", "name", "bands", "odd"],
                )

    return sketch


def sketches(docs: DataFrame, p: Near) -> DataFrame:
    """doc_id, n_shingles, bytes, name (of the set), bands and odd sketch of each row; the last three null without words."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_sketches(p), f"doc_id {kind}, n_shingles long, bytes long, name binary, bands array<long>, odd array<long>")


def estimate(a: Column, b: Column, samples: int) -> Column:
    """Similarity from the number of bits in which two odd sketches differ."""
    z = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    gap = F.greatest(F.lit(1.0) - 2.0 * z / BITS, F.lit(1e-9))
    return F.lit(1.0) + F.lit(BITS / (4.0 * samples)) * F.log(gap)


def _set_list(column: pa.Array, n: int) -> list[np.ndarray]:
    """Each text's sorted set of n-word shingles."""
    each = [(h, bounds) for t in W.texts(column) for h, bounds in [W.sets(*t.words(), n)]]
    return [h[bounds[i] : bounds[i + 1]] for h, bounds in each for i in range(len(bounds) - 1)]


def _shared(sets: list[np.ndarray], i: int, others: np.ndarray, whole: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of set i and others; `whole` has all sets' elements numbered, and their bounds."""
    if len(others) < 16:
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in others])
    ids, bounds = whole
    mark = np.zeros(int(ids.max()) + 1, dtype=np.int32)
    mark[ids[bounds[i] : bounds[i + 1]]] = 1
    return np.add.reduceat(mark[ids], bounds[:-1])[others]


def _links_in_block(p: Near):
    """Links between components that meet in a block of a bucket, confirmed on full sets: as many as join the
    components that have links here, not one for each pair.

    A pair is looked at in the first band that it shares, if its sketches look alike, unless links found before have
    joined its components already.
    """
    limit = BITS / 2 * (1 - np.exp(-4 * p.samples * (1 - (p.percent / 100 - p.slack)) / BITS))

    def links(group: pa.Table) -> pa.Table:
        names, side = group["name"].to_pylist(), np.array(group["side"])
        bits = np.array(group["odd"].to_pylist(), dtype=np.int64).view(np.uint64)
        bands = np.array(group["bands"].to_pylist(), dtype=np.int64)
        ids = {r: i for i, r in enumerate(dict.fromkeys(group["root"].to_pylist()))}
        root = np.array([ids[r] for r in group["root"].to_pylist()])
        here = int(np.flatnonzero(bands[0] == group["band"][0].as_py())[0])
        sets = _set_list(group["text"].combine_chunks(), p.shingle)
        size = np.array([len(x) for x in sets])
        whole = np.unique(np.concatenate(sets), return_inverse=True)[1], np.append(0, np.cumsum(size))
        to = np.arange(len(ids))
        out = []
        right = np.flatnonzero(side != 0)
        for i in np.flatnonzero(side != 1):
            other = right[(to[root[right]] != to[root[i]]) & ((side[i] == 0) | (right > i))]
            other = other[np.bitwise_count(bits[other] ^ bits[i]).sum(axis=1) <= limit]
            other = other[~(bands[other, :here] == bands[i, :here]).any(axis=1)]
            if not len(other):
                continue
            both = _shared(sets, i, other, whole)
            for j in other[100 * both >= p.percent * (size[i] + size[other] - both)]:
                a, b = to[root[i]], to[root[j]]
                if a != b:
                    to[to == max(a, b)] = min(a, b)
                    out.append((names[i], names[j]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([x for _, x in out], pa.binary())})

    return links


def _confirm(p: Near):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, dtype=bool)
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                own = _set_list(pa.concat_arrays([part["ta"], part["tb"]]), p.shingle)
                for i in range(part.num_rows):
                    x, y = own[i], own[part.num_rows + i]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[lo + i] = both > 0 and 100 * both >= p.percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([b["a"].filter(pa.array(keep)), b["b"].filter(pa.array(keep))], names=["a", "b"])

    return confirm


class Linker:
    """Links that join all similar sets of one table, each confirmed on full sets.

    Nodes are sets, named by 128 bits; all documents with an equal set are one node. First every bucket of a band
    links its members to its least member: a row a member, not a pair. Then only buckets whose other members are
    still in several components are looked at again, in blocks of bounded size, for links between components. Members
    of the component that has most of the bucket aren't compared with each other, only the others are with all: a
    few strays among many copies cost one more copy of each, not a block against every block. So every link that shares
    a band either was confirmed or joins documents that other links join.
    """

    def __init__(self, docs: DataFrame, p: Near, scratch: Scratch):
        self.docs, self.p, self.scratch = docs, p, scratch
        self.found = scratch.save(sketches(docs, p), "sketches")
        # one document stands for each set: its bands, its sketch and, for confirming, its text
        rows = self.found.where("name IS NOT NULL").groupBy("name").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "bands", "odd", "bytes")).alias("_d"))
        rows = scratch.save(rows.select("name", "_d.doc_id", "_d.bands", "_d.odd", "_d.bytes"), "nodes")
        self.rows, self.nodes, self.odd = rows, rows.select("name", "doc_id"), rows.select("name", "odd")
        self.bands = rows.select("name", F.explode("bands").alias("band"))

    def sketch_of(self, names: DataFrame, column: str) -> DataFrame:
        return names.join(self.odd.select(F.col("name").alias(column), F.col("odd").alias(f"odd_{column}")), column)

    def texts(self, names: DataFrame) -> DataFrame:
        """(name, text) of these nodes, the only ones whose texts leave their place."""
        wanted = self.scratch.save(self.nodes.join(names, "name", "left_semi"), "wanted")
        # these ids grow with the corpus: never broadcast, however few they are in a small one
        found = self.docs.select("doc_id", "text").join(wanted.hint("merge"), self.docs["doc_id"].eqNullSafe(wanted["doc_id"]))
        # rows that share a doc_id but not a text are told apart by their set's name
        return self.scratch.save(self.renamed(found), "texts")

    def renamed(self, texts: DataFrame) -> DataFrame:
        p = self.p

        def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = pa.array([x == y for x, y in zip(text_names(b["text"], p.shingle), b["name"].to_pylist(), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([b["name"].filter(keep), b["text"].filter(keep)], names=["name", "text"])

        return texts.select("name", "text").mapInArrow(same, "name binary, text string").dropDuplicates(["name"])

    def links(self) -> DataFrame:
        p, save = self.p, self.scratch.save
        least = save(self.bands.groupBy("band").agg(F.min("name").alias("a"), F.count("*").alias("n")).where("n > 1"), "leaders")
        members = save(self.bands.join(least, "band").where("name != a").select("band", "n", "a", "name"), "members")
        pairs = save(members.groupBy("a", F.col("name").alias("b")).agg(F.max("n").alias("n")), "stars")
        # a leader of many members meets them in parts, as many as its buckets' sizes ask for
        stars = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / STAR)).cast("int").alias("part"))
        heads = save(stars.select("a", "part").distinct(), "heads")
        texts = self.texts(heads.select(F.col("a").alias("name")).unionByName(stars.select(F.col("b").alias("name"))).distinct())
        alike = estimate(F.col("odd_a"), F.col("odd_b"), p.samples) >= p.percent / 100 - p.slack
        ta, tb = (texts.select(F.col("name").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")
        led = save(self.sketch_of(heads, "a").join(ta, "a"), "led")
        near = self.sketch_of(stars, "b").join(led.select("a", "part", "odd_a"), ["a", "part"]).where(alike).select("a", "part", "b")
        near = near.join(tb, "b").join(led.select("a", "part", "ta"), ["a", "part"])
        links = save(near.select("a", "b", "ta", "tb").mapInArrow(_confirm(p), "a binary, b binary"), "first")
        roots = components(links, self.scratch, "first-roots")
        placed = members.where("n > 2").join(roots, F.col("name") == F.col("node"), "left")
        placed = save(placed.select("band", "name", F.coalesce("root", "name").alias("root")), "placed")
        by_root = placed.groupBy("band", "root").agg(F.count("*").alias("n"))
        several = by_root.groupBy("band").agg(F.max(F.struct("n", "root")).alias("most"), F.count("*").alias("roots")).where("roots > 1")
        # saved first: a join with a table, not with a running sum by band, can be split where a band is large
        several = save(several.select("band", F.col("most.root").alias("major")), "several")
        rows = placed.join(several, "band").join(self.rows.select("name", "bytes"), "name")
        rows = save(rows.select("band", "name", "root", (F.col("root") != F.col("major")).alias("stray"), "bytes"), "rest")
        some = lambda c, x: F.sum(F.when(F.col("stray") == c, x).otherwise(0))
        parts = lambda c: F.greatest(F.ceil(some(c, F.lit(1)) / BLOCK), F.ceil(some(c, F.col("bytes")) / BLOCK_BYTES)).cast("int")
        sizes = save(rows.groupBy("band").agg(parts(True).alias("strays"), parts(False).alias("majors")), "sizes")
        rows = rows.join(sizes, "band")
        own = F.pmod(F.xxhash64("name"), F.when(F.col("stray"), F.col("strays")).otherwise(F.col("majors"))).cast("int")
        rows = rows.withColumn("own", own)
        # a block of strays meets itself (side 2), every other one once, and every block of the rest (side 0 against 1)
        upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        meet = lambda lo, hi, kind, side: F.struct(lo.alias("lo"), hi.alias("hi"), F.lit(kind).alias("kind"), side.alias("side"))
        mine, zero, one = F.col("own"), F.lit(0), F.lit(1)
        strays = F.transform(upto("strays"), lambda k: meet(F.least(mine, k), F.greatest(mine, k), 0, F.when(k == mine, 2).when(mine < k, 0).otherwise(1)))
        strays = F.concat(strays, F.transform(upto("majors"), lambda k: meet(mine, k, 1, zero)))
        other = F.when(F.col("stray"), strays).otherwise(F.transform(upto("strays"), lambda k: meet(k, mine, 1, one)))
        rows = rows.select("band", "name", "root", F.explode(other).alias("_o")).select("band", "_o.*", "name", "root")
        rows = rows.join(self.rows.select("name", "bands", "odd"), "name").join(texts, "name")
        more = rows.groupBy("band", "lo", "hi", "kind").applyInArrow(_links_in_block(p), "a binary, b binary")
        found = save(links.unionByName(save(more, "more")), "links")
        self.scratch.drop("leaders", "members", "stars", "heads", "led", "wanted", "texts", "first", "placed", "several", "rest", "sizes", "more")
        return found


def near_duplicates(docs: DataFrame, p: Near | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links lead to) and kept, for every row of `docs`.

    Texts are compared whole, as sets of word shingles with A-Z lowered; a shorter text is one shingle, and a null,
    empty or blank one has an empty set and is linked with nothing. Rows with equal sets are linked. Rows that share
    a doc_id are compared each by its own text. A null doc_id comes after all others; other columns don't matter. No
    rows give none.
    """
    scratch = Scratch(docs.sparkSession, "neardup")
    return scratch.last(_judged(docs, p or Near(), scratch).select("doc_id", "n_shingles", "component_id", "kept"))


def _judged(docs: DataFrame, p: Near, scratch: Scratch) -> DataFrame:
    """What `near_duplicates` returns, with each row's name and `first`: whether one of the rows with this doc_id and
    name is to stand for the component."""
    linker = Linker(docs, p, scratch)
    roots = components(linker.links(), scratch, "all")
    named = linker.nodes.join(roots, linker.nodes["name"] == roots["node"], "left").select("name", "doc_id", F.coalesce("root", "name").alias("root"))
    named = scratch.save(named, "named")
    first = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "name")).alias("_f"))
    labels = named.join(first, "root").select("name", F.col("_f.doc_id").alias("component_id"), (F.col("name") == F.col("_f.name")).alias("_first"))
    out = linker.found.select("doc_id", "n_shingles", "name").join(labels, "name", "left")
    component = F.when(F.col("name").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(
        "doc_id", "n_shingles", "name", component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), component.isNull() & F.col("doc_id").isNull()).alias("kept"),
        (F.coalesce("_first", F.lit(False)) & F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("first"),
    )


def one_of_each(docs: DataFrame, p: Near) -> DataFrame:
    """One row of each component stays, one with its least doc_id, and every row without words, with all columns.

    Rows are told apart by doc_id and their set's name, so ids may be null or repeated, and other columns may have any
    names. Only rows with repeated ids are named again. The ids that go grow with the corpus, so that they meet the documents in a shuffled join at
    every size.
    """
    scratch = Scratch(docs.sparkSession, "kept")
    rows = scratch.save(_judged(docs, p, scratch).select("doc_id", "name", "first", (F.col("first") | F.col("name").isNull()).alias("stays")), "rows")
    scratch.drop("sketches", "nodes", "links", "named")
    ids = scratch.save(rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("stays").alias("stays")).where("n > 1 OR NOT stays"), "ids")
    own = packed(docs, id=F.col("doc_id"), text=F.col("text"))
    met = ids.select(F.col("doc_id").alias("gone"))
    once = own.join(met.hint("merge"), own["id"].eqNullSafe(met["gone"]), "left_anti").select("row")
    twice = ids.where("stays").select(F.col("doc_id").alias("gone"))
    again = own.join(twice, own["id"].eqNullSafe(twice["gone"]), "left_semi")

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("name", pa.array(text_names(b["text"], p.shingle), pa.binary()))

    again = scratch.save(again.mapInArrow(name, T.StructType([*again.schema.fields, T.StructField("name", T.BinaryType())])), "again")
    firsts = rows.where("first").select(F.col("doc_id").alias("first_id"), F.col("name").alias("first_name"))
    first = again.join(firsts, (again["name"] == firsts["first_name"]) & again["id"].eqNullSafe(firsts["first_id"]), "left_semi").dropDuplicates(["id", "name"])
    return unpacked(once.unionByName(again.where("name IS NULL").select("row")).unionByName(first.select("row")), docs.columns)


def drop_duplicates(docs: DataFrame, p: Near) -> DataFrame:
    """`one_of_each`, and of the rows that it leaves under one doc_id (or without one) a single one, whatever the texts.

    For tables whose ids are unique by contract; `one_of_each` loses nothing on others.
    """
    return one_of_each(docs, p).dropDuplicates(["doc_id"])
