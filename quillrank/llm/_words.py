"""Vectorised words and 64-bit hashes over Arrow text columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which on UTF-8 equals `[^\\x20\\x09-\\x0D]+` on
code points. Hashes are polynomial over a fixed random byte table and finished with a 64-bit mixer, so that every
worker and every run gives equal values.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_P = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_TABLE = np.random.default_rng(20240501).integers(0, 1 << 64, 256, dtype=U)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NEWLINE = np.zeros(256, dtype=bool)
NEWLINE[0x0A] = True
#: Bytes of text handled at once; what is derived from them takes some 40 bytes a byte.
CHUNK = 1 << 18


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finisher: every bit of the input reaches every bit of the output."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def chain(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Hash of a sequence that goes on with one more element."""
    return mix(first * U(0x9FB21C651E98DF25) + then)


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as far as asked for."""

    up = np.ones(1, dtype=U)
    down = np.ones(1, dtype=U)

    @classmethod
    def upto(cls, n: int) -> None:
        if len(cls.up) < n:
            size = max(n, CHUNK + CHUNK // 8)
            for name, base in (("up", _P), ("down", pow(_P, -1, 1 << 64))):
                steps = np.full(size, base, dtype=U)
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))


def segments(data: np.ndarray, bounds: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without separators; no run goes over a document's bound."""
    inside = ~sep[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    cuts = bounds[bounds < len(data)]
    start[cuts] = inside[cuts]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    last = bounds[bounds > 0] - 1
    end[last] = inside[last]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges (none empty, in order, without overlap).

    Ranges are taken in runs of about CHUNK bytes, and a longer range in pieces: what is held beside a very long text
    doesn't grow with it.
    """
    out = np.empty(len(starts), dtype=U)
    _Powers.upto(CHUNK + 1)
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = int(np.searchsorted(ends, a + CHUNK, side="right"))
        if j > i:
            part, at = data[a : int(ends[j - 1])], np.empty(2 * (j - i), dtype=np.int64)
            at[0::2], at[1::2] = starts[i:j] - a, ends[i:j] - a
            terms = _TABLE[part]
            terms *= _Powers.up[: len(part)]
            out[i:j] = np.add.reduceat(terms, at[:-1])[::2] * _Powers.down[starts[i:j] - a]
        else:
            j, total = i + 1, 0
            for lo in range(a, int(ends[i]), CHUNK):
                part = data[lo : min(lo + CHUNK, int(ends[i]))]
                total += int((_TABLE[part] * _Powers.up[: len(part)]).sum()) * pow(_P, lo - a, 1 << 64)
            out[i] = total & _MASK
        i = j
    return mix(out + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


@dataclass
class Texts:
    """Some documents of a batch: `bounds[i]:bounds[i+1]` of `data` is the text of row `rows.start + i`."""

    rows: slice
    data: np.ndarray
    bounds: np.ndarray

    def words(self, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of all documents and, for each document, where its words begin (one bound more)."""
        data = _LOWER[self.data] if lower else self.data
        starts, ends = segments(data, self.bounds, SPACE)
        return hashes(data, starts, ends), np.searchsorted(starts, self.bounds)


def texts(column: pa.Array, chunk: int = CHUNK) -> Iterator[Texts]:
    """The column's whole texts in runs of about `chunk` bytes; a null is an empty text, a longer text is alone."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    # what earlier batches took goes back before the next is worked on
    pa.default_memory_pool().release_unused()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, values = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(values, dtype=np.uint8) if values is not None and values.size else np.empty(0, dtype=np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + chunk, side="right")) - 1)
        yield Texts(slice(i, j), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def owners(bounds: np.ndarray) -> np.ndarray:
    """For each element, the row that it belongs to."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def windows(words: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows that stay in their document, and the index of each one's first word."""
    if len(words) < n:
        return np.empty(0, dtype=U), np.empty(0, dtype=np.int64)
    first = np.flatnonzero(np.arange(len(words)) + n <= bounds[1:][owners(bounds)])
    h = words[first]
    for k in range(1, n):
        h = chain(h, words[first + k])
    return h, first


def sets(words: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-word shingles of each document, and bounds.

    A document with fewer words has its whole sequence as one; one without words has none.
    """
    h, first = windows(words, bounds, n)
    owner = owners(bounds)[first]
    short = np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) < n))
    if len(short):
        own = []
        for i in short:
            w = words[bounds[i] : bounds[i + 1]]
            x = w[:1]
            for k in range(1, len(w)):
                x = chain(x, w[k : k + 1])
            own.append(mix(x + U(len(w)))[0])
        h, owner = np.concatenate([h, np.array(own, dtype=U)]), np.concatenate([owner, short])
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(owner[order], kind="stable")]
    h, owner = h[order], owner[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[keep], owner[keep]
    return h, np.searchsorted(owner, np.arange(len(bounds)))
