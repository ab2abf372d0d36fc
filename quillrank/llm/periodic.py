"""Runs of words that repeat with a period: a harmonic grid, prefix hashes and common extensions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillrank.llm import _words as W

U = np.uint64
#: Pairs of a period and a grid point that are looked at together.
PAIRS = 1 << 19
KIND = "struct<n_words:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class _Prefix:
    """Prefix hashes of a sequence: equal stretches have equal hashes, others differ but for rare accidents."""

    def __init__(self, ids: np.ndarray):
        W._Powers.upto(len(ids) + 1)
        self.up = W._Powers.up
        self.sums = np.zeros(len(ids) + 1, dtype=U)
        np.cumsum(W.mix(ids.astype(U) + U(0x5851F42D4C957F2D)) * self.up[: len(ids)], out=self.sums[1:])

    def same(self, a: np.ndarray, p: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from a are those from a + p, for all at once."""
        return (self.sums[a + n] - self.sums[a]) * self.up[p] == self.sums[a + p + n] - self.sums[a + p]


def _extend(h: _Prefix, at: np.ndarray, p: np.ndarray, least: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """How far the words from `at` on (before it, if `back`) are those p further on: binary searches for all at once."""
    lo, hi = least.copy(), most.copy()
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_] + 1) // 2
        ok = h.same(at[open_] - (mid if back else 0), p[open_], mid)
        lo[open_[ok]], hi[open_[~ok]] = mid[ok], mid[~ok] - 1
    return lo


def _stretches(ids: np.ndarray, begin: int, end: int, p: int) -> tuple[np.ndarray, np.ndarray]:
    """All maximal stretches of a document with period p, word by word: starts and ends."""
    same = np.concatenate([[False], ids[begin : end - p] == ids[begin + p : end], [False]])
    edge = np.flatnonzero(same[1:] != same[:-1])
    return begin + edge[0::2], begin + edge[1::2] + p


def runs(ids: np.ndarray, bounds: np.ndarray, least: int = 6, times: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of the runs of all documents (`bounds[i]:bounds[i+1]` of `ids`), by start and period.

    A run is a maximal stretch with a smallest period q that is `least` words and `times` (3 or more) times q long at
    least. For each period p, grid points lie p apart: n + n/2 + n/3 ... pairs. A run has a grid point or more whose
    next p words come again right after; of neighbouring ones the first is extended both ways. The words of what is found
    are compared, and where a hash deceived, the document's stretches of that period are taken word by word. A stretch
    found with several periods has the least of them, as it divides the others.
    """
    if times < 3:
        raise ValueError("a run has three periods at least")
    sizes = np.diff(bounds)
    h = _Prefix(ids)
    last = sizes // times
    doc = np.repeat(np.arange(len(sizes)), last)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(last) - last, last) + 1
    points = sizes[doc] // period - 1
    upto = np.concatenate([[0], np.cumsum(points)])
    found, lo = [], 0
    while lo < len(doc):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + PAIRS, side="right")) - 1)
        n = points[lo:hi]
        entry = np.repeat(np.arange(lo, hi), n)
        p = period[entry]
        nth = np.arange(len(entry)) - np.repeat(upto[lo:hi] - upto[lo], n)
        g = bounds[doc[entry]] + nth * p
        again = np.flatnonzero(h.same(g, p, p))
        entry, p, nth, g = entry[again], p[again], nth[again], g[again]
        lo = hi
        if not len(g):
            continue
        new = np.ones(len(g), dtype=bool)
        new[1:] = (entry[1:] != entry[:-1]) | (nth[1:] != nth[:-1] + 1)
        chain = np.cumsum(new) - 1
        heads = np.flatnonzero(new)
        while len(heads):
            at, q = g[heads], p[heads]
            b, e = bounds[doc[entry[heads]]], bounds[doc[entry[heads]] + 1]
            start = at - _extend(h, at, q, np.zeros_like(at), at - b, True)
            end = at + q + _extend(h, at, q, q, e - at - q, False)
            long = end - start >= np.maximum(least, times * q)
            found.append(np.stack([start, end, q, doc[entry[heads]]])[:, long])
            # a grid point that its chain's head doesn't reach (as a hash deceived) heads the rest of the chain
            reach = np.full(chain[-1] + 1, np.iinfo(np.int64).max)
            reach[chain[heads]] = end - q
            left = np.flatnonzero(g >= reach[chain])
            first = np.ones(len(left), dtype=bool)
            first[1:] = chain[left][1:] != chain[left][:-1]
            heads = left[first]
    if not found:
        return (np.empty(0, dtype=np.int64),) * 3
    every = np.concatenate(found, axis=1)
    while True:
        start, end, q, of = one = _least_period(every)
        wrong = _deceived(ids, bounds, start, end, q, of)
        if not wrong.any():
            return start, end, q
        pairs = np.unique(one[2:, wrong], axis=1)
        code = lambda x: x[1] * (len(ids) + 1) + x[0]
        exact = [every[:, ~np.isin(code(every[2:]), code(pairs))]]
        for p, d in pairs.T:
            a, z = _stretches(ids, int(bounds[d]), int(bounds[d + 1]), int(p))
            long = z - a >= max(least, times * p)
            exact.append(np.stack([a[long], z[long], np.full(long.sum(), p), np.full(long.sum(), d)]))
        every = np.concatenate(exact, axis=1)


def _least_period(found: np.ndarray) -> np.ndarray:
    """Stretches by start, then period; of equal ones the one with the least period."""
    found = found[:, np.lexsort((found[2], found[1], found[0]))]
    keep = np.ones(found.shape[1], dtype=bool)
    keep[1:] = (found[:2, 1:] != found[:2, :-1]).any(axis=0)
    found = found[:, keep]
    return found[:, np.lexsort((found[2], found[0]))]


def _deceived(ids: np.ndarray, bounds: np.ndarray, start: np.ndarray, end: np.ndarray, q: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which stretches' words don't have the period, or whose neighbours do have it."""
    wrong = np.zeros(len(start), dtype=bool)
    n = end - q - start
    i = 0
    while i < len(n):
        j = max(i + 1, int(np.searchsorted(np.cumsum(n[i:]), PAIRS, side="right")) + i)
        a = np.repeat(start[i:j], n[i:j]) + np.arange(n[i:j].sum()) - np.repeat(np.cumsum(n[i:j]) - n[i:j], n[i:j])
        unlike = ids[a] != ids[a + np.repeat(q[i:j], n[i:j])]
        wrong[i:j] = np.add.reduceat(unlike, np.cumsum(n[i:j]) - n[i:j]) > 0
        i = j
    before, after = np.flatnonzero(start > bounds[of]), np.flatnonzero(end < bounds[of + 1])
    wrong[before] |= ids[start[before] - 1] == ids[start[before] - 1 + q[before]]
    wrong[after] |= ids[end[after]] == ids[end[after] - q[after]]
    return wrong


def _words(t: W.Texts) -> tuple[pa.Array, np.ndarray]:
    """The words themselves, and each document's bounds in them."""
    starts, ends = W.segments(t.data, t.bounds, W.SPACE)
    offsets = np.zeros(len(starts) + 1, dtype=np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(t.data[~W.SPACE[t.data]])])
    return words, np.searchsorted(starts, t.bounds)


def _found(t: W.Texts) -> pa.Array:
    words, bounds = _words(t)
    # numbers of distinct words, not hashes: equal numbers are equal words
    ids = np.array(words.dictionary_encode().indices, dtype=np.int64)
    start, end, q = runs(ids, bounds)
    owner = np.searchsorted(bounds, start, side="right") - 1
    drop = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(drop, start + q, 1)
    np.add.at(drop, end, -1)
    kept = np.flatnonzero(np.cumsum(drop)[:-1] == 0)
    offsets = lambda own: pa.array(np.searchsorted(own, np.arange(len(bounds))), pa.int32())
    rows = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start - bounds[owner], end - start, q)], fields=list(_RUN))
    texts = pa.ListArray.from_arrays(pa.array(np.searchsorted(kept, bounds), pa.int32()), words.take(pa.array(kept)))
    return pa.StructArray.from_arrays(
        [pa.array(np.diff(bounds), pa.int64()), pa.ListArray.from_arrays(offsets(owner), rows), pc.binary_join(texts, " ")], names=["n_words", "runs", "collapsed"]
    )


def periodic_runs(text: Column) -> Column:
    """A struct of `n_words`, `runs` (start, length and period in words, by start, then period) and `collapsed`, the text's
    words joined by one space without those that a run holds after its first period.

    Runs are maximal stretches of six words and four of their smallest periods at least. A null, empty or blank text has
    no words, no runs and an empty collapsed text. Whole texts are worked on, a very long one alone.
    """

    @F.arrow_udf(KIND)
    def found(column: pa.Array) -> pa.Array:
        out = [_found(t) for t in W.texts(column)]
        return pa.concat_arrays(out) if out else pa.array([], pa.struct([("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())]))

    return found(text)
