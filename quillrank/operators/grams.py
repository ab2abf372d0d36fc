"""Grams of words, counted where one of their words belongs.

A gram belongs to its first word in an order of words, of equal ones the leftmost: by a hash, with frequent words last. So a
chunk of documents doesn't send its grams to those who count them. It sends each place of a word once, with the words beside
it that come after it in the order: for 1- to 3-grams less than two words a place, where the grams have six. Grams of
frequent words alone go by a hash of their own, summed up in the chunk, so that no bucket has all of a frequent word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rank of the least frequent of the frequent words; all others have a hash below.
OFTEN = 1 << 32
#: Between a section's name and its word.
MARK = "\x01"
#: Rows of a batch that goes to Spark.
ROWS = 1 << 15
#: Bytes of text by which frequent words are told.
SAMPLE = 16 << 20


def pack(x: np.ndarray) -> bytes:
    """Numbers by planes of as many bytes as the largest one needs, which compress well."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    x = np.zeros(((len(data) - 1) // width, 8), dtype=np.uint8)
    x[:, :width] = np.frombuffer(data, dtype=np.uint8, offset=1).reshape(width, len(x)).T
    return x.view("<i8").ravel()


def sealed(*parts: bytes) -> bytes:
    """Parts as one compressed string, with its length before it."""
    whole = np.array([len(parts), *map(len, parts)], dtype="<u4").tobytes() + b"".join(parts)
    return len(whole).to_bytes(8, "little") + pa.compress(whole, codec="zstd", asbytes=True)


def opened(data: bytes) -> list[bytes]:
    whole = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    sizes = np.frombuffer(whole, dtype="<u4", offset=4, count=int.from_bytes(whole[:4], "little"))
    ends = np.cumsum(sizes) + 4 * (len(sizes) + 1)
    return [whole[z - n : z] for z, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


def frequent(docs: DataFrame, key: str, sections: Column, size: int, buckets: int) -> list[str]:
    """Words that would fill a quarter of a bucket or more, the most frequent last: at most four a bucket. They are told by a part
    of the documents, whose texts have `size` bytes: they only decide where a gram is counted, no result rests on them."""
    each = max(1, -(-size // SAMPLE))
    words = docs.where(F.pmod(F.xxhash64(key), F.lit(each)) == 0).select(F.explode_outer(F.flatten(F.transform(sections, lambda s: s["terms"]))).alias("word")).where("word IS NOT NULL")
    counted = words.groupBy("word").agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n")).first()[0] or 0
    return [r["word"] for r in counted.where(F.col("n") > max(20, total // (4 * buckets))).orderBy("n", "word").collect()]


class Strings:
    """Strings of which runs are written out as they lie."""

    def __init__(self, a: pa.Array):
        a = a.cast(pa.large_string())
        _, offsets, data = a.buffers()
        self.offsets = np.frombuffer(offsets, dtype=np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, dtype=np.int64)
        self.data = memoryview(data) if data is not None else memoryview(b"")

    def parts(self, lo: int, hi: int) -> tuple[bytes, bytes]:
        at = self.offsets[lo : hi + 1]
        return pack(np.diff(at)), bytes(self.data[at[0] : at[-1]])


def strings(sizes: bytes, data: bytes) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(unpack(sizes))]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.tobytes()), pa.py_buffer(data))


def _listed(a: pa.Array) -> np.ndarray:
    return a.to_numpy(zero_copy_only=False).astype(np.int64)


class Words:
    """A chunk's words in lists, each of a document's place and a section: `names[code]` are the words, `lists` says which list
    has each. Places rise from one list to the next."""

    def __init__(self, names: pa.Array, code: np.ndarray, sizes: np.ndarray, slot: np.ndarray, section: np.ndarray, sections: list):
        self.names, self.code, self.sizes, self.sections = names.cast(pa.large_string()), code, sizes, sections
        self.lists = np.repeat(np.arange(len(sizes)), sizes)
        self.slot, self.section = slot[self.lists], section[self.lists]
        self._of = slot, section

    @classmethod
    def read(cls, batches: list[pa.RecordBatch], slots: np.ndarray) -> Words:
        """`slots` are the places of the batches' rows; column `sections` has (section, terms)."""
        rows = pa.chunked_array([b["sections"] for b in batches]).combine_chunks()
        names, lists = pc.list_flatten(rows).flatten()
        known = names.is_valid()
        names, lists, owner = names.filter(known), lists.filter(known), pc.list_parent_indices(rows).filter(known)
        kinds = names.dictionary_encode()
        terms = pc.list_flatten(lists).dictionary_encode()
        sizes = _listed(pc.fill_null(pc.list_value_length(lists), 0))
        return cls(terms.dictionary, _listed(terms.indices), sizes, slots[_listed(owner)], _listed(kinds.indices), kinds.dictionary.to_pylist())

    def documents(self) -> list[int]:
        """How many documents have words of each section."""
        each = np.unique(self.slot * len(self.sections) + self.section)
        return np.bincount(each % max(len(self.sections), 1), minlength=len(self.sections)).tolist()

    def runs(self, m: int) -> np.ndarray:
        """Places where m words of a list begin."""
        at = np.arange(len(self.code) - m + 1)
        return at[self.lists[at] == self.lists[at + m - 1]]

    def stored(self) -> bytes:
        return sealed(*Strings(self.names).parts(0, len(self.names)), *map(pack, (self.code, self.sizes, *self._of)), *Strings(pa.array(self.sections, type=pa.string())).parts(0, len(self.sections)))

    @classmethod
    def restored(cls, data: bytes) -> Words:
        a, b, *numbers, c, d = opened(data)
        return cls(strings(a, b), *map(unpack, numbers), strings(c, d).to_pylist())


def chunks(key: str, most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, list[pa.RecordBatch]]]:
    """Distinct keys, rows' places among them (-1: null) and batches (key, sections) of about `most` bytes of words. Rows come
    in the order of keys; those of a key stay together."""

    def done(held: list[pa.RecordBatch]) -> tuple[pa.Array, np.ndarray, list[pa.RecordBatch]]:
        keys = pa.chunked_array([b[key] for b in held]).combine_chunks().dictionary_encode()
        return keys.dictionary, _listed(keys.indices.fill_null(-1)), held

    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        end, lists = 0, pc.list_flatten(b["sections"]).flatten()[1]
        owner = _listed(pc.list_parent_indices(b["sections"]))[_listed(pc.list_parent_indices(lists))]
        bytes_of = np.bincount(owner, _listed(pc.fill_null(pc.binary_length(pc.list_flatten(lists)), 0)) + 1, len(b)).tolist()
        last = held[-1][key][-1] if held else None
        for i in range(len(b)):
            now = b[key][i]
            if size >= most and now != last:
                if i > end:
                    held.append(b.slice(end, i - end))
                    end = i
                yield done(held)
                held, size = [], 0
            size += bytes_of[i]
            last = now
        held.append(b.slice(end))
    if held:
        yield done(held)


def shapes(n: int) -> list[tuple[int, int]]:
    """Words before and after the word that a gram belongs to."""
    return [(a, b) for a in range(n) for b in range(n - a)]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def keyed(first: np.ndarray, rest: list[np.ndarray], count: int) -> np.ndarray:
    """One number for each combination of numbers; those of `rest` are below `count`."""
    key, count = first, max(count, 1)
    for x in rest:
        if int(key.max(initial=0)) >= (1 << 62) // count:
            key = np.unique(key, return_inverse=True)[1]
        key = key * count + x
    return key


def tally(key: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order by keys, where each begins in it, its number and that of its documents: places rise within a key, and 0 is no
    document."""
    order = np.argsort(key, kind="stable")
    k, s = key[order], slot[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = k[1:] != k[:-1]
    begin = np.flatnonzero(new)
    new[1:] |= s[1:] != s[:-1]
    docs = np.add.reduceat((new & (s > 0)).astype(np.int64), begin) if len(begin) else begin
    return order, begin, np.diff(begin, append=len(k)), docs


class Grams:
    """The 1- to n-grams of a chunk by bucket: places of words with what is beside them (`at`, `left`, `right`, in the order of
    buckets and words), and grams of frequent words alone (`often`)."""

    def __init__(self, words: Words, n: int, buckets: int, last: list[str], named: bool):
        """`last` are the frequent words, the most frequent at the end; `named`: a section's grams are its own."""
        w, self.n, self.buckets, self.named = words, n, buckets, named
        self.words = w
        crc = np.fromiter(map(zlib.crc32, w.names.cast(pa.large_binary()).to_pylist()), dtype=np.int64, count=len(w.names))
        rank = crc.copy()
        if last:
            found = _listed(pc.index_in(w.names, value_set=pa.array(last, type=pa.large_string())).fill_null(-1))
            rank = np.where(found >= 0, OFTEN + found, rank)
        self._crc = crc
        self._kind = np.array([zlib.crc32((s or "").encode()) if named else 0 for s in w.sections], dtype=np.int64)
        r = rank[w.code]
        left, right = np.zeros((2, len(r)), dtype=np.int64)
        more, after = np.ones((2, len(r)), dtype=bool)
        for k in range(1, n):
            same = w.lists[k:] == w.lists[:-k]
            more[k:] &= same & (r[:-k] > r[k:])
            after[:-k] &= same & (r[k:] >= r[:-k])
            more[:k] = after[max(len(r) - k, 0) :] = False
            left += more
            right += after
        self.left, self.right = left, right
        group = (w.section if named else 0) * len(w.names) + w.code
        rare = np.flatnonzero(r < OFTEN)
        kinds, gid = np.unique(group[rare], return_inverse=True)
        bucket = self._bucket(crc[kinds % max(len(w.names), 1)] + self._kind[kinds // max(len(w.names), 1)] * named)
        order = np.lexsort((gid, bucket[gid]))
        self.at, self.group = rare[order], group
        self._places = bucket[gid][order]
        by = np.argsort(bucket, kind="stable")
        self._kinds, self._each, self._groups = kinds[by], np.bincount(gid, minlength=len(kinds))[by], bucket[by]
        self.often = self._often(np.flatnonzero(r >= OFTEN))

    def _bucket(self, h: np.ndarray) -> np.ndarray:
        return (mixed(h) % np.uint64(self.buckets)).astype(np.int64)

    def named_of(self, group: np.ndarray) -> pa.Array:
        """Words of groups, behind their sections' names if these count."""
        own = self.words.names.take(pa.array(group % max(len(self.words.names), 1)))
        if not self.named:
            return own
        kinds = pa.array([s or "" for s in self.words.sections], type=pa.large_string()).take(pa.array(group // max(len(self.words.names), 1)))
        return pc.binary_join_element_wise(kinds, own, pa.scalar(MARK, pa.large_string()))

    def beside(self, at: np.ndarray, a: int, b: int) -> list[np.ndarray]:
        """Codes of the words around places, from the left, without the places' own."""
        return [self.words.code[at + k] for k in (*range(-a, 0), *range(1, b + 1))]

    def chosen(self, at: np.ndarray, a: int, b: int) -> np.ndarray:
        return at[(self.left[at] >= a) & (self.right[at] >= b)]

    def _often(self, at: np.ndarray) -> dict:
        """Distinct grams of frequent words, by bucket: their strings, numbers, documents; of each shape its places and which of
        the grams each has."""
        w, names, buckets, n, docs, of, base = self.words, [], [], [], [], [], 0
        for a, b in shapes(self.n):
            own = self.chosen(at, a, b)
            beside = self.beside(own, a, b)
            order, begin, count, owners = tally(keyed(self.group[own], beside, len(w.names)), w.slot[own])
            which = np.empty(len(own), dtype=np.int64)
            which[order] = np.repeat(np.arange(len(begin)) + base, count)
            first = order[begin]
            h = self._crc[w.code[own[first]]] + (self._kind[w.section[own[first]]] if self.named else 0)
            for i, x in enumerate(beside):
                h = mixed(h).astype(np.int64) + self._crc[x[first]] + i
            words = [w.names.take(pa.array(x[first])) for x in beside]
            middle = w.names.take(pa.array(w.code[own[first]]))
            text = joined([*words[:a], middle, *words[a:]])
            if self.named:
                kinds = pa.array([s or "" for s in w.sections], type=pa.large_string()).take(pa.array(w.section[own[first]]))
                text = pc.binary_join_element_wise(kinds, text, pa.scalar(MARK, pa.large_string()))
            names.append(text)
            buckets.append(self._bucket(h))
            n.append(count)
            docs.append(owners)
            of.append(((a, b), own, which))
            base += len(begin)
        bucket = np.concatenate(buckets)
        by = np.argsort(bucket, kind="stable")
        back = np.empty(len(by), dtype=np.int64)
        back[by] = np.arange(len(by))
        return {"text": pa.concat_arrays(names).take(pa.array(by)), "bucket": bucket[by], "n": np.concatenate(n)[by], "docs": np.concatenate(docs)[by], "of": [(shape, own, back[which]) for shape, own, which in of]}

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        """(bucket, data) of all buckets that get something."""
        w, at = self.words, self.at
        both = self.left[at] + self.right[at]
        ends = np.concatenate([[0], np.cumsum(both)])
        step = np.arange(ends[-1]) - np.repeat(ends[:-1], both)
        near = np.repeat(at - self.left[at], both) + step
        near += step >= np.repeat(self.left[at], both)
        beside = Strings(w.names.take(pa.array(w.code[near])))
        groups, text = Strings(self.named_of(self._kinds)), Strings(self.often["text"])
        some = np.unique(np.concatenate([self._groups, self.often["bucket"]]))
        cut = lambda x: (np.searchsorted(x, some, "left"), np.searchsorted(x, some, "right"))
        slot, sides = w.slot[at], self.left[at] * self.n + self.right[at]
        for bucket, g0, g1, p0, p1, o0, o1 in zip(some.tolist(), *cut(self._groups), *cut(self._places), *cut(self.often["bucket"]), strict=True):
            own = [pack(self._each[g0:g1]), pack(slot[p0:p1]), pack(sides[p0:p1])]
            yield bucket, sealed(*groups.parts(g0, g1), *own, *beside.parts(ends[p0], ends[p1]), *text.parts(o0, o1), pack(self.often["n"][o0:o1]), pack(self.often["docs"][o0:o1]))


def joined(words: list[pa.Array]) -> pa.Array:
    return pc.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string())) if len(words) > 1 else words[0]


class Bucket:
    """What all chunks have sent to a bucket."""

    def __init__(self, blocks: list[bytes], n: int):
        self.n = n
        parts = [opened(b) for b in blocks]
        number = lambda i: [unpack(p[i]) for p in parts]
        text = lambda i: pa.concat_arrays([strings(p[i], p[i + 1]) for p in parts]).dictionary_encode()
        groups, beside, often = text(0), text(5), text(7)
        self.groups, self.names, self.frequent = groups.dictionary, beside.dictionary, often.dictionary
        slots = number(3)
        self.sizes = [len(s) for s in slots]
        # places of several chunks' documents don't meet: each chunk's come after those of the one before
        base = np.concatenate([[0], np.cumsum([int(s.max(initial=0)) + 1 for s in slots])])
        self.slot = np.concatenate([np.where(s > 0, s + b, 0) for s, b in zip(slots, base[:-1], strict=True)])
        self.group = np.repeat(_listed(groups.indices), np.concatenate(number(2)))
        sides = np.concatenate(number(4))
        self.left, self.right = sides // n, sides % n
        self._middle = np.cumsum(self.left + self.right) - self.right
        self._beside = _listed(beside.indices)
        self.often, self.often_n, self.often_docs = _listed(often.indices), np.concatenate(number(9)), np.concatenate(number(10))
        self.often_sizes = [len(unpack(p[9])) for p in parts]

    def shape(self, a: int, b: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Places that have grams of a shape, and codes of the words beside them, from the left."""
        at = np.flatnonzero((self.left >= a) & (self.right >= b))
        middle = self._middle[at]
        return at, [self._beside[middle + k] for k in range(-a, b)]

    def counted(self) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """All grams with their number and that of their documents."""
        for a, b in shapes(self.n):
            at, beside = self.shape(a, b)
            order, begin, n, docs = tally(keyed(self.group[at], beside, len(self.names)), self.slot[at])
            for i in range(0, len(begin), ROWS):
                first = order[begin[i : i + ROWS]]
                words = [self.names.take(pa.array(x[first])) for x in beside]
                yield joined([*words[:a], self.groups.take(pa.array(self.group[at[first]])), *words[a:]]), n[i : i + ROWS], docs[i : i + ROWS]
        n, docs = (np.bincount(self.often, x, len(self.frequent)).astype(np.int64) for x in (self.often_n, self.often_docs))
        for i in range(0, len(n), ROWS):
            yield self.frequent.slice(i, ROWS), n[i : i + ROWS], docs[i : i + ROWS]

    def documents(self) -> list[bytes]:
        """For each block in how many documents its grams are: of each shape at all places that have it, then of frequent ones."""
        edges, out = np.cumsum(self.sizes)[:-1], [[] for _ in self.sizes]
        for a, b in shapes(self.n):
            at, beside = self.shape(a, b)
            order, begin, n, docs = tally(keyed(self.group[at], beside, len(self.names)), self.slot[at])
            df = np.empty(len(at), dtype=np.int64)
            df[order] = np.repeat(docs, n)
            for own, part in zip(out, np.split(df, np.searchsorted(at, edges)), strict=True):
                own.append(pack(part))
        df = np.bincount(self.often, self.often_docs, len(self.frequent)).astype(np.int64)[self.often]
        for own, part in zip(out, np.split(df, np.cumsum(self.often_sizes)[:-1]), strict=True):
            own.append(pack(part))
        return [sealed(*own) for own in out]


def sent(key: str, n: int, buckets: int, last: list[str], most: int):
    """Sorted documents (key, sections) as blocks (bucket, data) of their chunks. Documents with a null key are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, slots, held in chunks(key, most, batches):
            rows = list(Grams(Words.read(held, slots + 1), n, buckets, last, False).blocks())
            for i in range(0, len(rows), 256):
                bucket, data = zip(*rows[i : i + 256], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(data, pa.binary())], names=["bucket", "data"])

    return run


def counts(n: int):
    """Blocks of a bucket as grams (gram, n, docs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list] = {}
        for b in batches:
            for bucket, data in zip(b["bucket"].to_pylist(), b["data"].to_pylist(), strict=True):
                by.setdefault(bucket, []).append(data)
        for bucket in list(by):
            for gram, number, docs in Bucket(by.pop(bucket), n).counted():
                yield pa.RecordBatch.from_arrays([gram.cast(pa.string()), pa.array(number), pa.array(docs)], names=["gram", "n", "docs"])

    return run


def stored(key: str, most: int, out: pa.Schema):
    """Sorted documents (key, sections) as chunks of their words (chunk, keys, names, docs, data): `keys` begins with null, a
    document's slot is the place of its key there, and `docs` is how many have each of the sections `names`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for keys, slots, held in chunks(key, most, batches):
            words = Words.read(held, slots + 2)
            row = [chunk, [None, None, *keys.to_pylist()], words.sections, words.documents(), words.stored()]
            yield pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip(row, out, strict=True)], schema=out)
            chunk += 1

    return run


def dealt(n: int, buckets: int, last: list[str]):
    """Chunks (chunk, data) as blocks (bucket, chunk, data); a section's grams are its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, data in zip(b["chunk"].to_pylist(), b["data"].to_pylist(), strict=True):
                rows = list(Grams(Words.restored(data), n, buckets, last, True).blocks())
                for i in range(0, len(rows), 256):
                    bucket, block = zip(*rows[i : i + 256], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array([chunk] * len(bucket)), pa.array(block, pa.binary())], names=["bucket", "chunk", "data"])

    return run


def documents(n: int):
    """Blocks (bucket, chunk, data) of a bucket as answers: in how many documents the block's grams are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list] = {}
        for b in batches:
            for bucket, chunk, data in zip(*(b[c].to_pylist() for c in ("bucket", "chunk", "data")), strict=True):
                by.setdefault(bucket, []).append((chunk, data))
        for bucket in list(by):
            chunk, data = zip(*by.pop(bucket), strict=True)
            for i, answer in enumerate(Bucket(list(data), n).documents()):
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([chunk[i]]), pa.array([answer], pa.binary())], names=["bucket", "chunk", "data"])

    return run


def _each(key: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each document's gram, and how often the document has it. Places rise within a key."""
    order = np.argsort(key, kind="stable")
    new = np.ones(len(order), dtype=bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (slot[order][1:] != slot[order][:-1])
    begin = np.flatnonzero(new)
    return order[begin], np.diff(begin, append=len(order))


def lengths(n: int, buckets: int, last: list[str], sizes: dict[str, int], sublinear: bool, min_df: int, out: pa.Schema):
    """Of a chunk's words and their answers the lengths of its documents, by section: of all terms (`every`) and of those in
    `min_df` documents or more (`fine`), with the most documents that a term of the section has."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own, answers = next(r for r in rows if r["bucket"] is None), sorted((r for r in rows if r["bucket"] is not None), key=lambda r: r["bucket"])
        words = Words.restored(own["data"])
        if not answers:
            return out.empty_table()
        grams, found = Grams(words, n, buckets, last, True), [opened(r["data"]) for r in answers]
        df = [np.concatenate([unpack(f[i]) for f in found]) for i in range(len(shapes(n)) + 1)]
        kinds, total = len(words.sections), (int(words.slot.max()) + 1) * len(words.sections)
        size = np.array([sizes[s] for s in words.sections], dtype=np.float64)
        every, fine, most = np.zeros(total), np.zeros(total), np.zeros(kinds, dtype=np.int64)
        parts = [(shape, grams.chosen(grams.at, *shape), d) for shape, d in zip(shapes(n), df, strict=False)]
        for (a, b), at, d in [*parts, *((shape, at, df[-1][which]) for shape, at, which in grams.often["of"])]:
            first, tf = _each(keyed(grams.group[at], grams.beside(at, a, b), len(words.names)), words.slot[at])
            place, d = at[first], d[first]
            section = words.section[place]
            np.maximum.at(most, section, d)
            w = (np.log((1 + size[section]) / (1 + d)) + 1) * (1 + np.log(tf) if sublinear else tf)
            where = words.slot[place] * kinds + section
            every += np.bincount(where, w * w, total)
            fine += np.bincount(where, w * w * (d >= min_df), total)
        at = np.flatnonzero(every > 0)
        slot, section, names = at // kinds, at % kinds, pa.array(words.sections, type=pa.string())
        keys = pa.array(own["keys"], type=out.field(2).type)
        columns = [np.full(len(at), own["chunk"]), slot, keys.take(pa.array(slot)), names.take(pa.array(section)), np.sqrt(every[at]), np.sqrt(fine[at]), most[section]]
        return pa.table([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], schema=out)

    return run


def _wanted(words: Words, terms: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(m, places, terms' numbers) where terms of m words begin: words are followed as far as some term goes on with them."""
    split = pc.split_pattern(terms, " ") if n > 1 else pa.array([[t] for t in terms.to_pylist()], type=pa.list_(pa.large_string()))
    count = _listed(pc.list_value_length(split))
    code = _listed(pc.index_in(pc.list_flatten(split), value_set=words.names).fill_null(-1))
    begin, v = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64), max(len(words.names), 1)
    node, last, key = np.zeros(len(terms), dtype=np.int64), np.arange(len(terms)), np.zeros(len(words.code), dtype=np.int64)
    at = np.arange(len(words.code))
    for m in range(1, n + 1):
        # terms that are longer, by the number of what they have in common so far
        last = last[(count[last] >= m) & (node[last] >= 0)]
        now = code[begin[last] + m - 1]
        last, now = last[now >= 0], now[now >= 0]
        known = np.unique(node[last] * v + now)
        node[last] = np.searchsorted(known, node[last] * v + now)
        at = at[at + m <= len(words.code)]
        at = at[words.lists[at] == words.lists[at + m - 1]] if len(at) else at
        asked = key[at] * v + words.code[at + m - 1]
        place = np.searchsorted(known, asked)
        hit = (known[np.minimum(place, len(known) - 1)] == asked) if len(known) else np.zeros(len(at), dtype=bool)
        at = at[hit]
        key[at] = place[hit]
        whole = last[count[last] == m]
        term = np.full(len(known), -1)
        term[node[whole]] = whole
        own = term[key[at]] if len(known) else at[:0]
        yield m, at[own >= 0], own[own >= 0]


def found(n: int, key: str, out: pa.Schema):
    """Chunks (chunk, keys, data, wanted) as documents' terms (section, word, chunk, slot, key, n): those that are wanted, or all
    where that is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                words = Words.restored(r["data"])
                keys, names = pa.array(r["keys"], type=out.field(key).type), pa.array(words.sections, type=pa.string())
                if r["wanted"] is None:
                    runs = ((m, words.runs(m), None) for m in range(1, n + 1) if m <= len(words.code))
                else:
                    terms = pa.array(r["wanted"], type=pa.large_string())
                    runs = _wanted(words, terms, n)
                for m, at, which in runs:
                    codes = [words.code[at + k] for k in range(m)] if which is None else [which]
                    one = keyed(words.section[at], codes, len(words.names) if which is None else len(terms))
                    first, tf = _each(one, words.slot[at])
                    for i in range(0, len(first), ROWS):
                        own = first[i : i + ROWS]
                        text = joined([words.names.take(pa.array(c[own])) for c in codes]) if which is None else terms.take(pa.array(which[own]))
                        slot = pa.array(words.slot[at[own]])
                        columns = [names.take(pa.array(words.section[at[own]])), text.cast(pa.string()), pa.array(np.full(len(own), r["chunk"])), slot, keys.take(slot), pa.array(tf[i : i + ROWS])]
                        yield pa.RecordBatch.from_arrays(columns, schema=out)

    return run
