"""Exact duplicates: counting quotient filters of fingerprints, and a comparison of whole texts where they repeat."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.llm import _words as W
from quillrank.llm._scratch import Scratch

U = np.uint64
#: Ranges of fingerprints are filters of about this many at most; there are LEAST_RANGES of them or more.
PER_RANGE, LEAST_RANGES = 1 << 21, 64
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PARTS = "part int, at int, quotient_bits int, occupied binary, ends binary, remainders binary, many binary, counts binary"


def lowered(text: Column) -> Column:
    """A-Z to lower case and nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text in UTF-8, as 32 bytes."""

    @F.arrow_udf("binary")
    def digests(column: pa.Array) -> pa.Array:
        out = []
        for t in W.texts(column):
            data = W._LOWER[t.data].tobytes()
            out += [hashlib.sha256(data[a:b]).digest() for a, b in zip(t.bounds[:-1], t.bounds[1:], strict=True)]
        return pa.array(out, pa.binary())

    return digests(text)


def fingerprint(sha: Column, bits: int) -> Column:
    """The leading `bits` of a digest as an unsigned number, in the bits of a long."""
    head = F.conv(F.hex(F.substring(sha, 1, 8)), 16, -10).cast("long")
    return head if bits == 64 else F.shiftrightunsigned(head, 64 - bits)


@dataclass
class CountingQuotientFilter:
    """A multiset of fingerprints of `bits` bits, without loss.

    The leading `quotient_bits` of a fingerprint are its quotient, the rest its remainder. Slots hold the remainders of
    one quotient after those of another, sorted, each once: a bit for each quotient tells whether it has a run of slots,
    a bit for each slot whether its run ends there, and a bit whether its count is above one; such counts stand apart.
    """

    bits: int
    quotient_bits: int
    occupied: np.ndarray
    ends: np.ndarray
    remainders: np.ndarray
    many: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray, counts: np.ndarray, bits: int) -> CountingQuotientFilter:
        """Of distinct sorted fingerprints and their counts."""
        q = min(bits, max(1, int(len(values)).bit_length()))
        quotient = (values >> U(bits - q)).astype(np.int64)
        occupied = np.zeros(1 << q, dtype=bool)
        occupied[quotient] = True
        ends = np.ones(len(values), dtype=bool)
        ends[:-1] = quotient[1:] != quotient[:-1]
        remainders = values & U((1 << (bits - q)) - 1)
        return cls(bits, q, occupied, ends, remainders, counts > 1, counts[counts > 1])

    def read(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct fingerprints, sorted, and their counts."""
        run = np.cumsum(self.ends) - self.ends
        values = (np.flatnonzero(self.occupied)[run].astype(U) << U(self.bits - self.quotient_bits)) | self.remainders
        counts = np.ones(len(values), dtype=np.int64)
        counts[self.many] = self.counts
        return values, counts

    @classmethod
    def merged(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """One filter of all: sorted remainders are merged quotient by quotient, counts of equal ones added."""
        values, counts = (np.concatenate(x) for x in zip(*(f.read() for f in filters), strict=True))
        return cls.of(*_summed(values, counts), filters[0].bits)

    def stored(self) -> tuple[bytes, ...]:
        """Bits packed by eight; remainders in as many bytes as they need."""
        width = -(-(self.bits - self.quotient_bits) // 8)
        small = self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        return np.packbits(self.occupied).tobytes(), np.packbits(self.ends).tobytes(), small.tobytes(), np.packbits(self.many).tobytes(), self.counts.astype("<i8").tobytes()

    @classmethod
    def loaded(cls, bits: int, quotient_bits: int, occupied: bytes, ends: bytes, remainders: bytes, many: bytes, counts: bytes, slots: int) -> CountingQuotientFilter:
        flags = lambda x, n: np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=n).astype(bool)
        width = -(-(bits - quotient_bits) // 8)
        wide = np.zeros((slots, 8), dtype=np.uint8)
        wide[:, :width] = np.frombuffer(remainders, dtype=np.uint8).reshape(slots, width)
        return cls(bits, quotient_bits, flags(occupied, 1 << quotient_bits), flags(ends, slots), wide.view("<u8").ravel(), flags(many, slots), np.frombuffer(counts, dtype="<i8"))


def _summed(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.ones(len(values), dtype=bool)
    first[1:] = values[1:] != values[:-1]
    at = np.flatnonzero(first)
    return values[at], np.add.reduceat(counts, at) if len(at) else counts


def _build(bits: int, range_bits: int):
    """A partition's fingerprints as one filter for each range that it has any of."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.array(b["print"]).view(U) for b in batches]
        values = np.concatenate(seen) if seen else np.empty(0, dtype=U)
        values, counts = _summed(values, np.ones(len(values), dtype=np.int64))
        part = (values >> U(bits - range_bits)).astype(np.int64)
        inner = values & U((1 << (bits - range_bits)) - 1)
        cuts = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
        rows = []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            f = CountingQuotientFilter.of(inner[lo:hi], counts[lo:hi], bits - range_bits)
            rows.append((int(part[lo]), int(hi - lo), f.quotient_bits, *f.stored()))
        names = ["part", "at", "quotient_bits", "occupied", "ends", "remainders", "many", "counts"]
        kinds = [pa.int32()] * 3 + [pa.binary()] * 5
        for lo in range(0, len(rows), 1_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[lo : lo + 1_000], strict=True), kinds, strict=True)], names=names)

    return build


def _merge(bits: int, range_bits: int):
    """The fingerprints of a range that all its filters together count more than once."""

    def merge(group: pa.Table) -> pa.Table:
        stored = ("occupied", "ends", "remainders", "many", "counts")
        rows = zip(*(group[c].to_pylist() for c in ("quotient_bits", *stored, "at")), strict=True)
        whole = CountingQuotientFilter.merged([CountingQuotientFilter.loaded(bits - range_bits, *r) for r in rows])
        values, counts = whole.read()
        values |= U(group["part"][0].as_py()) << U(bits - range_bits)
        return pa.table({"print": pa.array(values[counts > 1].view(np.int64), pa.int64()), "n": pa.array(counts[counts > 1], pa.int64())})

    return merge


def repeated(prints: DataFrame, bits: int) -> DataFrame:
    """(print, n) of the fingerprints (column `print`) that occur more than once, n times in all.

    Each partition's filter is cut by ranges of fingerprints, and the filters of a range are merged in a task. A
    fingerprint, however frequent, is one slot of a partition's filter.
    """
    n = max(prints.count(), 1)
    range_bits = min(bits - 1, max(LEAST_RANGES.bit_length() - 1, (n // PER_RANGE).bit_length()))
    parts = prints.select("print").mapInArrow(_build(bits, range_bits), _PARTS)
    return parts.groupBy("part").applyInArrow(_merge(bits, range_bits), "print long, n long")


def exact_duplicates(docs: DataFrame, bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row of `docs` (doc_id, text; other columns are left out).

    Texts are equal when they are the same after A-Z is put into lower case; a null text counts as empty, and so all of
    these are one group. The row with the largest doc_id stays; of rows that share it one stays, and a null doc_id is
    less than any. No rows give none.

    Fingerprints are the first `bits` of the normalised text's SHA-256. Where filters count one more than once, its whole
    texts are compared by grouping them; copies in one task are one row before they are shuffled. Other texts aren't
    moved, if the repeated fingerprints are few enough for Spark to broadcast; else texts meet them in a join that it
    can split.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    keyed = docs.select("doc_id", digest(F.col("text")).alias("sha")).withColumns({"print": fingerprint(F.col("sha"), bits), "uid": F.monotonically_increasing_id()})
    keyed = scratch.save(keyed, "keyed")
    again = scratch.save(repeated(keyed, bits).select("print"), "again")
    texts = docs.select("text", fingerprint(digest(F.col("text")), bits).alias("print")).join(again, "print").select(lowered(F.col("text")).alias("text"))
    same = texts.groupBy("text").agg(F.count("*").alias("n")).where("n > 1").select(F.unhex(F.sha2("text", 256)).alias("sha"))
    same = scratch.save(same.distinct(), "same")
    best = keyed.join(same, "sha").groupBy("sha").agg(F.max(F.struct("doc_id", "uid")).alias("keep"), F.count("*").alias("n"))
    best = scratch.save(best.select("sha", "keep.*", "n").withColumnsRenamed({"doc_id": "keep_id", "uid": "keep_uid"}), "best")
    out = keyed.join(best, "sha", "left")
    return scratch.last(
        out.select(
            "doc_id",
            F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
            F.coalesce(F.col("uid") == F.col("keep_uid"), F.lit(True)).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
        )
    )
