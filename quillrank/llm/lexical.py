"""Ranked search over inverted treaps: a term's postings are a search tree by document and a heap by impact."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillrank.llm import _words as W
from quillrank.llm._scratch import Scratch

U = np.uint64
#: Bytes of text whose documents make a shard. Each shard has its own treaps, and is searched in one task.
SHARD = 1 << 24
#: Queries, and bytes of their texts, that go through the index together.
QUERIES, QUERY_BYTES = 512, 1 << 22
#: Ranges of documents that the traversal splits at once: at first, and at most.
FEW, MANY = 16, 512
SEPARATOR = np.ones(256, dtype=bool)
SEPARATOR[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_INDEX = "shard long, term string, df long, root int, at array<int>, impact array<int>, left array<int>, right array<int>, ids array<long>"


def _split(t: W.Texts) -> tuple[pa.Array, np.ndarray]:
    """The terms themselves, with A-Z in lower case, and each document's bounds in them."""
    data = W._LOWER[t.data]
    starts, ends = W.segments(data, t.bounds, SEPARATOR)
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    terms = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[~SEPARATOR[data]])])
    return terms, np.searchsorted(starts, t.bounds)


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = total = 0
    for b in batches:
        for t in W.texts(b["text"]):
            starts, _ = W.segments(t.data, t.bounds, SEPARATOR)
            n = np.diff(np.searchsorted(starts, t.bounds))
            docs, total = docs + int((n > 0).sum()), total + int(n.sum())
    yield pa.RecordBatch.from_pydict({"docs": pa.array([docs], pa.int64()), "total": pa.array([total], pa.int64())})


def treaps(bounds: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Root of each list, and left and right child of each posting (-1: none), all counted from the list's start.

    Lists (`bounds[i]:bounds[i+1]` of `key`) are in order of documents; keys within a list differ. A posting's parent is
    the lesser of the nearest greater ones on both sides, which are found for all at once by jumps that double.
    """
    n, sizes = len(key), np.diff(bounds)
    at = np.arange(n)
    before, after = at - 1, at + 1
    before[bounds[:-1][sizes > 0]], after[bounds[1:][sizes > 0] - 1] = -1, -1
    for side in (before, after):
        some = np.flatnonzero(side >= 0)
        while len(some := some[side[some] >= 0]) and len(some := some[key[side[some]] < key[some]]):
            side[some] = side[side[some]]
    up = np.where(before < 0, after, np.where((after < 0) | (key[before] < key[after]), before, after))
    left, right = np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    under, over = np.flatnonzero((up >= 0) & (up == before)), np.flatnonzero((up >= 0) & (up == after))
    start = np.repeat(bounds[:-1], sizes)
    right[up[under]], left[up[over]] = under - start[under], over - start[over]
    top = np.flatnonzero(up < 0)
    return top - start[top], left, right


def _shard(ids: pa.Array, texts: pa.Array, number: int, n_docs: int, total: int) -> Iterator[pa.RecordBatch]:
    """A row for each term of the documents, after one that holds their ids (term: empty)."""
    order = pc.array_sort_indices(ids)
    ids, texts = ids.take(order), texts.take(order)
    (t,) = W.texts(texts, chunk=1 << 62)
    terms, bounds = _split(t)
    coded = terms.dictionary_encode()
    n = np.diff(bounds)
    pair = np.repeat(np.arange(len(n)), n) + np.array(coded.indices, dtype=np.int64) * len(n)
    pair, tf = np.unique(pair, return_counts=True)
    term, at = pair // len(n), pair % len(n)
    m = np.array([100 - 90 + (90 * x * n_docs) // total if total else 0 for x in n.tolist()], dtype=np.int64)
    impact = 1_000_000_000 * tf // (1_000 * tf + 8 * m[at])
    lists = np.searchsorted(term, np.arange(len(coded.dictionary) + 1))
    # equal impacts in an order of their own, else a tree of equal documents were a chain
    root, left, right = treaps(lists, (impact.astype(U) << U(32)) | (at.astype(U) * U(2654435761) & U(0xFFFFFFFF)))

    def rows(names: pa.Array, df: np.ndarray, top: np.ndarray, cut: np.ndarray, *columns: np.ndarray, own: pa.Array | None = None) -> pa.RecordBatch:
        cut = pa.array(cut - cut[0], pa.int32())
        parts = [pa.ListArray.from_arrays(cut, pa.array(x, pa.int32())) for x in columns] or [pa.nulls(len(names), pa.list_(pa.int32()))] * 4
        ids = own if own is not None else pa.nulls(len(names), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(names), number), pa.int64()), names, pa.array(df, pa.int64()), pa.array(top, pa.int32()), *parts, ids], names=["shard", "term", "df", "root", "at", "impact", "left", "right", "ids"])

    yield rows(pa.array([""]), [len(ids)], [-1], np.zeros(2, dtype=np.int64), own=pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids))
    dictionary = coded.dictionary.cast(pa.string())
    for lo in range(0, len(dictionary), 4_096):
        hi = min(lo + 4_096, len(dictionary))
        cut = lists[lo : hi + 1]
        yield rows(dictionary[lo:hi], np.diff(cut), root[lo:hi], cut, *(x[cut[0] : cut[-1]] for x in (at, impact, left, right)))


def _index(n_docs: int, total: int):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, part, number = [], 0, TaskContext.get().partitionId(), 0

        def flush() -> Iterator[pa.RecordBatch]:
            ids, texts = (pa.chunked_array([b[c] for b in held]).combine_chunks() for c in ("doc_id", "text"))
            return _shard(ids, texts, (part << 24) + number, n_docs, total)

        for b in batches:
            sizes = np.array(pc.binary_length(b["text"]).fill_null(0), dtype=np.int64)
            lo = 0
            while lo < len(b):
                hi = max(lo + 1, int(np.searchsorted(np.cumsum(sizes[lo:]), SHARD - size, side="right")) + lo)
                held.append(b.slice(lo, hi - lo))
                size += int(sizes[lo:hi].sum())
                lo = hi
                if size >= SHARD or lo < len(b):
                    yield from flush()
                    held, size, number = [], 0, number + 1
        if held:
            yield from flush()

    return index


@dataclass
class Index:
    """The treaps of all terms and shards, with the number of documents that have a term and of all terms."""

    rows: DataFrame
    n_docs: int
    n_terms: int


def build(docs: DataFrame, scratch: Scratch) -> Index:
    """The index of `docs` (doc_id, text; other columns are left out), written to shared storage.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, of whole texts, with A-Z in lower
    case; a null or empty text has none and is found by no query. Rows with one doc_id, or without, are documents each.
    Texts are read twice: impacts need the mean length. No rows give an index without terms.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sums = docs.select("text").mapInArrow(_lengths, "docs long, total long").agg(F.sum("docs"), F.sum("total")).first()
    n_docs, total = (int(x or 0) for x in sums)
    return Index(scratch.save(docs.mapInArrow(_index(n_docs, total), _INDEX), "treaps"), n_docs, total)


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        row = 0
        for t in W.texts(b["text"]):
            terms, bounds = _split(t)
            owner = np.repeat(np.array(b["query"])[row : row + len(bounds) - 1], np.diff(bounds))
            row += len(bounds) - 1
            yield pa.RecordBatch.from_pydict({"query": pa.array(owner, pa.int64()), "term": terms.cast(pa.string())})


class _Best:
    """The k best of a query so far: higher scores first, of equal ones those with less doc_id (null last)."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.ids, self.known = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=bool)

    def add(self, score: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        score, ids, known = (np.concatenate(x) for x in ((self.score, score), (self.ids, ids), (self.known, known)))
        best = np.lexsort((ids, ~known, -score))[: self.k]
        self.score, self.ids, self.known = score[best], ids[best], known[best]

    def may_enter(self, most: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether a document of ranges with these bounds and these least ids may yet be among them."""
        if len(self.score) < self.k:
            return most > 0
        return (most > self.score[-1]) | ((most == self.score[-1]) & (ids <= self.ids[-1] if self.known[-1] else True))


@dataclass
class _Treaps:
    """The treaps of a shard: postings of all lists one after another, children as places in them."""

    at: np.ndarray
    impact: np.ndarray
    left: np.ndarray
    right: np.ndarray
    roots: dict[str, int]
    ids: np.ndarray
    known: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table) -> _Treaps:
        terms = rows["term"].to_pylist()
        ids = rows["ids"].combine_chunks()[terms.index("")].values
        lists = {c: rows[c].combine_chunks() for c in ("at", "impact", "left", "right")}
        sizes = np.array(pc.list_value_length(lists["at"]).fill_null(0), dtype=np.int64)
        start = np.cumsum(sizes) - sizes
        at, impact, left, right = (np.array(x.flatten(), dtype=np.int64) for x in lists.values())
        base = np.repeat(start, sizes)
        left, right = np.where(left < 0, -1, left + base), np.where(right < 0, -1, right + base)
        roots = np.array(rows["root"], dtype=np.int64) + start
        # a null id comes after all others, as its documents do
        known = np.array(ids.is_valid())
        return cls(at, impact, left, right, {t: int(r) for t, r in zip(terms, roots, strict=True) if t}, np.array(ids.fill_null(np.iinfo(np.int64).max)), known)

    def top(self, node: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """For each range of documents and each term, the posting of greatest impact within, below `node`."""
        out, terms = node.ravel().copy(), node.shape[1]
        lo, hi = np.repeat(lo, terms), np.repeat(hi, terms)
        go = np.flatnonzero(out >= 0)
        while len(go):
            at = self.at[out[go]]
            low = at < lo[go]
            off = low | (at >= hi[go])
            go, low = go[off], low[off]
            out[go] = np.where(low, self.right[out[go]], self.left[out[go]])
            go = go[out[go] >= 0]
        return out.reshape(node.shape)

    def gains(self, node: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return np.where(node >= 0, self.impact[node] * weights, 0)

    def search(self, terms: list[tuple[str, int]], best: _Best) -> None:
        """Put this shard's documents that belong among the best there.

        A range of documents has in each treap a subtree, whose root holds the greatest impact within; the sum over the
        terms bounds what any document of the range can score. Ranges whose sum is too small are left; of the others the
        most promising are split at the document of their greatest impact, which is scored exactly.
        """
        mine = [(self.roots[t], w) for t, w in terms if t in self.roots]
        if not mine:
            return
        weights = np.array([w for _, w in mine], dtype=np.int64)
        node, lo, hi = np.array([[r for r, _ in mine]]), np.array([0]), np.array([len(self.ids)])
        most, width = self.gains(node, weights).sum(axis=1), FEW
        while True:
            live = np.flatnonzero(best.may_enter(most, self.ids[lo]))
            if not len(live):
                return
            if len(live) > width:
                live = live[np.argsort(-most[live], kind="stable")]
            now, rest = live[:width], live[width:]
            width = min(2 * width, MANY)
            here, a, z = node[now], lo[now], hi[now]
            pick = self.gains(here, weights).argmax(axis=1)
            at = self.at[here[np.arange(len(now)), pick]]
            best.add(self.gains(self.top(here, at, at + 1), weights).sum(axis=1), self.ids[at], self.known[at])
            parts = np.concatenate([self.top(here, a, at), self.top(here, at + 1, z)])
            bound = self.gains(parts, weights).sum(axis=1)
            full = bound > 0
            node, most = np.concatenate([node[rest], parts[full]]), np.concatenate([most[rest], bound[full]])
            lo, hi = np.concatenate([lo[rest], np.concatenate([a, at + 1])[full]]), np.concatenate([hi[rest], np.concatenate([at, z])[full]])


def _search(queries: dict[int, list[tuple[str, int]]], k: int):
    """The best of a task's shards, one shard after another: what is found in one raises the bar for the next."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {q: _Best(k) for q in queries}
        held: list[pa.RecordBatch] = []

        def flush() -> None:
            shard = _Treaps.of(pa.Table.from_batches(held))
            for q, terms in queries.items():
                shard.search(terms, best[q])

        for b in batches:
            shards = np.array(b["shard"])
            cuts = np.append(np.flatnonzero(np.diff(shards, prepend=-1)), len(b))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if held and held[0]["shard"][0].as_py() != int(shards[lo]):
                    flush()
                    held = []
                held.append(b.slice(lo, hi - lo))
        if held:
            flush()
        for q, x in best.items():
            yield pa.RecordBatch.from_pydict({"query": pa.array([q] * len(x.score), pa.int64()), "doc_id": pa.array(x.ids, pa.int64(), mask=~x.known), "score": pa.array(x.score, pa.int64())})

    return search


def search(index: Index, queries: DataFrame, scratch: Scratch, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id and score of the `k` documents that score highest for each row of `queries` (item_id, text).

    A document scores, for each of the text's terms once, the term's weight floor(1000 * ln((2 N + 2) / (2 df + 1))) times
    its impact, the whole part of 10^9 tf / (1000 tf + 8 m) with m = 10 + the whole part of 90 n N / L. Only scores above
    0 count; equal ones are ranked by doc_id, a null one last. A null or empty query text finds nothing, repeated rows are
    queries each, and an index or a table of queries without rows gives none.

    Queries go through the index in blocks of bounded number and size, whose terms with their weights are sent to the
    tasks. A block's postings are shuffled by shard, not by term; a task gives k rows a query at most.
    """
    asked = scratch.save(queries.select("item_id", "text", F.monotonically_increasing_id().alias("query")), "asked")
    n, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // QUERIES), -(-size // QUERY_BYTES))
    terms = asked.select("query", "text").mapInArrow(_query_terms, "query long, term string").distinct()
    terms = scratch.save(terms.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks))), "terms")
    wanted = terms.select("term").distinct()
    df = index.rows.select("term", "df").join(wanted, "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(index.n_docs) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weighed = scratch.save(terms.join(df, "term").select("block", "query", "term", weight.alias("weight")).where("weight > 0"), "weighed")
    # the term under which a shard keeps its documents' ids
    ids_term = asked.sparkSession.range(1).select(F.lit("").alias("term"))
    found = []
    for block in range(blocks):
        own: dict[int, list[tuple[str, int]]] = {}
        for r in weighed.where(F.col("block") == block).collect():
            own.setdefault(r["query"], []).append((r["term"], r["weight"]))
        wanted = weighed.where(F.col("block") == block).select("term").distinct().unionByName(ids_term)
        rows = index.rows.join(wanted, "term", "left_semi")
        found.append(rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(_search(own, k), "query long, doc_id long, score long"))
    line = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= k)
    return asked.join(ranked, "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")

