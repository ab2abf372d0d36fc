"""An interpolated modified Kneser-Ney bigram model, counted in Spark and mapped into memory for scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm import _words as W
from quillrank.llm._files import Mapped, put
from quillrank.llm._scratch import Scratch

U = np.uint64
BEGIN, END = U(0x5851F42D4C957F2D), U(0x14057B7EF767814F)
#: Bytes of training text for which there is one shard more.
SHARD_BYTES = 48 << 20
#: Tokens that a task counts before it sends what it has.
FLUSH = 6_000_000
#: Bytes of text whose words and pairs are counted or looked up at once.
CHUNK = 1 << 20
_BLOBS = "shard int, a binary, b binary, n binary"


def _tokens(t: W.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with one end after each text's words, and bounds."""
    words, bounds = t.words()
    n = len(bounds) - 1
    out = np.empty(len(words) + n, dtype=U)
    ends = bounds[1:] + np.arange(n)
    at = np.ones(len(out), dtype=bool)
    at[ends] = False
    out[at], out[ends] = words, END
    return out, bounds + np.arange(n + 1)


def _before(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The token before each, or the beginning."""
    out = np.empty_like(tokens)
    out[1:] = tokens[:-1]
    out[bounds[:-1]] = BEGIN
    return out


def _sum_equal(keys: tuple[np.ndarray, ...], n: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Distinct keys in order (the first key counts most), and the sums of their numbers."""
    if not len(n):
        return keys, n
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    keys, n = tuple(k[order] for k in keys), n[order]
    new = np.ones(len(n), dtype=bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return tuple(k[new] for k in keys), np.add.reduceat(n, np.flatnonzero(new))


def _pair_counts(a: np.ndarray, b: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Distinct pairs of one text chunk and how often each occurs; local numbers make it one sort of one column."""
    names, ids = np.unique(np.concatenate([a, b]), return_inverse=True)
    codes, n = np.unique((ids[: len(a)].astype(U) << U(32)) | ids[len(a) :].astype(U), return_counts=True)
    return (names[(codes >> U(32)).astype(np.int64)], names[(codes & U(0xFFFFFFFF)).astype(np.int64)]), n


def _short(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """48 bits of a hash as 32 + 16: what a word is told by within pairs."""
    return (h >> U(32)).astype("<u4"), ((h >> U(16)) & U(0xFFFF)).astype("<u2")


def _long(hi: bytes, lo: bytes) -> np.ndarray:
    return (np.frombuffer(hi, dtype="<u4").astype(U) << U(32)) | (np.frombuffer(lo, dtype="<u2").astype(U) << U(16))


def _each_shard(merge: Callable[[pa.Table], pa.Table]):
    """`merge` of all rows of each shard in a partition, of which there is one a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        for b in batches:
            for shard in pc.unique(b["shard"]).to_pylist():
                held.setdefault(shard, []).append(b.filter(pc.equal(b["shard"], shard)))
        for shard in sorted(held):
            yield from merge(pa.Table.from_batches(held.pop(shard))).to_batches()

    return run


def _merged(blobs: DataFrame, bits: int, merge: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """Shards are dealt by their number, not by its hash, which would put several into one task."""
    return blobs.repartitionById(1 << bits, F.col("shard")).mapInArrow(_each_shard(merge), schema)


@dataclass
class Model:
    """Where the arrays are, and the few numbers that every worker needs.

    Words are spread over shards by hash; so are pairs, by their first word, but pairs that begin with one of the
    `frequent` words, by both. `frequent` has at most 24 words a shard, with their sums over shards in `stats`.
    """

    root: str
    bits: int
    tokens: int = 0
    words: int = 0
    pairs: int = 0
    pair_discounts: tuple = (0.0, 0.5, 1.0, 1.5)
    word_discounts: tuple = (0.0, 0.5, 1.0, 1.5)
    word_rest: float = 1.0
    frequent: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=U))
    stats: np.ndarray = field(default_factory=lambda: np.empty((0, 4), dtype=np.int64))
    shards: frozenset = frozenset()
    pair_shards: frozenset = frozenset()

    def word_shard(self, h: np.ndarray) -> np.ndarray:
        return (h >> U(64 - self.bits)).astype(np.int64)

    def pair_shard(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = self.word_shard(a)
        hot = np.isin(a, self.frequent)
        out[hot] = self.word_shard(W.chain(a[hot], (b[hot] >> U(16)) << U(16)))
        return out


def discounts(n: np.ndarray) -> tuple:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from how many things occur 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if min(n1, n2, n3, n4) <= 0:
        return (0.0, 0.5, 0.75, 0.9)
    y = n1 / (n1 + 2 * n2)
    out = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return (0.0, *(min(max(d, 0.05), k - 0.05) for k, d in enumerate(out, 1)))


def _of_counts(n: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(n, 5), minlength=6)[1:5].tolist()


def _count_words(bits: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def send() -> Iterator[pa.RecordBatch]:
            (h,), n = _sum_equal((np.concatenate([x for x, _ in held]),), np.concatenate([x for _, x in held]))
            shard = (h >> U(64 - bits)).astype(np.int64)
            at = np.searchsorted(shard, np.arange((1 << bits) + 1))
            full = np.flatnonzero(np.diff(at))
            part = lambda x, kind: pa.array([x[at[i] : at[i + 1]].astype(kind).tobytes() for i in full], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), part(h, "<u8"), pa.array([b""] * len(full), pa.binary()), part(n, "<i8")], names=["shard", "a", "b", "n"])

        for b in batches:
            for t in W.texts(b["text"], CHUNK):
                held.append(np.unique(_tokens(t)[0], return_counts=True))
                if sum(len(x) for x, _ in held) > FLUSH:
                    yield from send()
                    held.clear()
        if held:
            yield from send()

    return count


def _merge_words(root: str, least: int):
    def merge(group: pa.Table) -> pa.Table:
        shard = group["shard"][0].as_py()
        cat = lambda c, kind: np.frombuffer(b"".join(group[c].to_pylist()), dtype=kind)
        (h,), n = _sum_equal((cat("a", "<u8"),), cat("n", "<i8"))
        put(f"{root}/words/{shard}", {"h": h, "n": n.astype("<u4") if n.max() < 1 << 32 else n})
        hot = n >= least
        return pa.table({"shard": pa.array([shard], pa.int32()), "tokens": [int(n.sum())], "words": [len(h)], "hot": pa.array([h[hot].view(np.int64)], pa.list_(pa.int64()))})

    return merge


def _count_pairs(m: Model):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def send() -> Iterator[pa.RecordBatch]:
            (a, b), n = _sum_equal((np.concatenate([x[0][0] for x in held]), np.concatenate([x[0][1] for x in held])), np.concatenate([x[1] for x in held]))
            shard = m.pair_shard(a, b)
            order = np.argsort(shard, kind="stable")
            a, b, n = a[order], b[order], n[order]
            at = np.searchsorted(shard[order], np.arange((1 << m.bits) + 1))
            for i in np.flatnonzero(np.diff(at)):
                s = slice(at[i], at[i + 1])
                hi, lo = _short(b[s])
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *(pa.array([x], pa.binary()) for x in (a[s].tobytes(), hi.tobytes() + lo.tobytes(), n[s].astype("<u4").tobytes()))], names=["shard", "a", "b", "n"])

        size = 0
        for batch in batches:
            for t in W.texts(batch["text"], CHUNK):
                tokens, bounds = _tokens(t)
                held.append(_pair_counts(_before(tokens, bounds), tokens))
                size += len(held[-1][1])
                if size > FLUSH // 2:
                    yield from send()
                    held.clear()
                    size = 0
        if held:
            yield from send()

    return count


def _merge_pairs(m: Model):
    def merge(group: pa.Table) -> pa.Table:
        shard = group["shard"][0].as_py()
        n = np.frombuffer(b"".join(group["n"].to_pylist()), dtype="<u4").astype(np.int64)
        a = np.frombuffer(b"".join(group["a"].to_pylist()), dtype="<u8")
        b = np.concatenate([_long(x[: len(x) // 6 * 4], x[len(x) // 6 * 4 :]) for x in group["b"].to_pylist()])
        (a, b), n = _sum_equal((a, b), n)
        first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        rank = np.cumsum(np.append(False, a[1:] != a[:-1])).astype(U)
        stats = np.stack([np.add.reduceat(x.astype(np.int64), first) for x in (n, n == 1, n == 2, n >= 3)], axis=1)
        big = np.flatnonzero(n >= 255)
        put(f"{m.root}/pairs/{shard}", {
            "first": a[first], "stats": stats.astype("<u4") if stats.max() < 1 << 32 else stats, "key": (rank << U(40)) | (b >> U(24)), "n": np.minimum(n, 255).astype(np.uint8), "big": big, "big_n": n[big],
        })
        hot = np.isin(a[first], m.frequent)
        last, left = np.unique(b, return_counts=True)
        to = m.word_shard(last)
        at = np.searchsorted(to, np.arange((1 << m.bits) + 1))
        full = np.flatnonzero(np.diff(at))
        blob = lambda x, kind: [x[at[i] : at[i + 1]].astype(kind).tobytes() for i in full]
        hi, lo = _short(last)
        rows = len(full) + 1
        empty = [b""] * len(full)
        return pa.table({
            "from_shard": pa.array([shard] * rows, pa.int32()), "shard": pa.array([-1, *full], pa.int32()),
            "a": pa.array([a[first][hot].tobytes(), *blob(hi, "<u4")], pa.binary()),
            "b": pa.array([stats[hot].tobytes(), *blob(lo, "<u2")], pa.binary()),
            "n": pa.array([np.array([len(n), *_of_counts(n)], dtype="<i8").tobytes(), *(blob(left, "<u4") or empty)], pa.binary()),
        })

    return merge


def _finish_words(root: str):
    def finish(group: pa.Table) -> pa.Table:
        shard, own = group["shard"][0].as_py(), Mapped()
        h = np.array(own.get(f"{root}/words/{shard}", "h"))
        last = np.concatenate([_long(x, y) for x, y in zip(group["a"].to_pylist(), group["b"].to_pylist(), strict=True)])
        (last,), left = _sum_equal((last,), np.frombuffer(b"".join(group["n"].to_pylist()), dtype="<u4").astype(np.int64))
        at = np.minimum(np.searchsorted(last, (h >> U(16)) << U(16)), len(last) - 1)
        found = np.where(last[at] == (h >> U(16)) << U(16), left[at], 0)
        put(f"{root}/words/{shard}", {"left": found.astype("<u4")})
        own.close()
        n1, n2, n3, n4 = _of_counts(left)
        return pa.table({"shard": pa.array([shard], pa.int32()), "pairs": [int(left.sum())], "types": [len(left)], "n1": [n1], "n2": [n2], "n3": [n3], "n4": [n4]})

    return finish


def fit(docs: DataFrame, scratch: Scratch) -> Model:
    """Count a model over the whole texts of `docs` (column text; null is empty) into the scratch folder.

    Shards grow in number with the text, so that merging one stays within a fixed size: tasks sum words and pairs
    before they send them, as sorted arrays, to the shard's task, which merges them and writes sorted hash arrays.
    The driver sees one row of sums a shard. A word is told by 64 bits of
    hash on its own; as the second of a pair by 48 in counting and by 40, beside its first word, in the sorted arrays. Without
    rows the model has no words, and every token is unknown.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(3, int(size // SHARD_BYTES).bit_length())
    root, text = scratch.path("model"), docs.select("text")
    words = _merged(text.mapInArrow(_count_words(bits), _BLOBS), bits, _merge_words(root, max(64, size // (48 << bits))), "shard int, tokens long, words long, hot array<long>").collect()
    m = Model(root, bits, sum(r.tokens for r in words), sum(r.words for r in words), shards=frozenset(r.shard for r in words))
    m.frequent = np.sort(np.array([h for r in words for h in r.hot] + [BEGIN.astype(np.int64)], dtype=np.int64).view(U))
    pairs = _merged(text.mapInArrow(_count_pairs(m), _BLOBS), bits, _merge_pairs(m), f"from_shard int, {_BLOBS}")
    pairs = scratch.save(pairs, "merged")
    sums = pairs.where("shard = -1").select("from_shard", "a", "b", "n").collect()
    left = _merged(pairs.where("shard >= 0").drop("from_shard"), bits, _finish_words(root), "shard int, pairs long, types long, n1 long, n2 long, n3 long, n4 long").collect()
    scratch.drop("merged")
    m.pair_shards = frozenset(r.from_shard for r in sums)
    m.stats = np.zeros((len(m.frequent), 4), dtype=np.int64)
    if sums:
        m.pair_discounts = discounts(sum(np.frombuffer(r.n, dtype="<i8")[1:] for r in sums))
        for r in sums:
            m.stats[np.searchsorted(m.frequent, np.frombuffer(r.a, dtype="<u8"))] += np.frombuffer(r.b, dtype="<i8").reshape(-1, 4)
    if left:
        n = np.array([[r.n1, r.n2, r.n3, r.n4] for r in left]).sum(axis=0)
        d = m.word_discounts = discounts(n)
        m.pairs = sum(r.pairs for r in left)
        m.word_rest = (d[1] * n[0] + d[2] * n[1] + d[3] * (sum(r.types for r in left) - n[0] - n[1])) / m.pairs
    return m


class Scorer:
    def __init__(self, m: Model):
        self.m, self.maps = m, Mapped()

    def word(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of sorted words, and how many words stand before each."""
        m, n, left = self.m, np.zeros(len(h), dtype=np.int64), np.zeros(len(h), dtype=np.int64)
        at = np.searchsorted(m.word_shard(h), np.arange((1 << m.bits) + 1))
        for i in np.flatnonzero(np.diff(at)):
            if int(i) in m.shards:
                s = slice(at[i], at[i + 1])
                own = self.maps.get(f"{m.root}/words/{i}", "h")
                j = np.minimum(np.searchsorted(own, h[s]), len(own) - 1)
                hit = own[j] == h[s]
                n[s] = np.where(hit, self.maps.get(f"{m.root}/words/{i}", "n")[j], 0)
                left[s] = np.where(hit, self.maps.get(f"{m.root}/words/{i}", "left")[j], 0)
        return n, left

    def pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of pairs, and of what follows their first word: in all, once, twice, more often."""
        m, n, stats = self.m, np.zeros(len(a), dtype=np.int64), np.zeros((len(a), 4), dtype=np.int64)
        shard = m.pair_shard(a, b)
        order = np.argsort(shard, kind="stable")
        at = np.searchsorted(shard[order], np.arange((1 << m.bits) + 1))
        for i in np.flatnonzero(np.diff(at)):
            if int(i) not in m.pair_shards:
                continue
            s, uri = order[at[i] : at[i + 1]], f"{m.root}/pairs/{i}"
            first, key, count = (self.maps.get(uri, x) for x in ("first", "key", "n"))
            r = np.minimum(np.searchsorted(first, a[s]), len(first) - 1)
            known = first[r] == a[s]
            stats[s] = np.where(known[:, None], self.maps.get(uri, "stats")[r], 0)
            k = (r.astype(U) << U(40)) | (b[s] >> U(24))
            j = np.minimum(np.searchsorted(key, k), len(key) - 1)
            c = np.where(known & (key[j] == k), count[j], 0).astype(np.int64)
            many = np.flatnonzero(c == 255)
            if len(many):
                c[many] = self.maps.get(uri, "big_n")[np.searchsorted(self.maps.get(uri, "big"), j[many])]
            n[s] = c
        if len(m.frequent):
            j = np.minimum(np.searchsorted(m.frequent, a), len(m.frequent) - 1)
            hot = m.frequent[j] == a
            stats[hot] = m.stats[j[hot]]
        return n, stats

    def score(self, t: W.Texts) -> dict[str, np.ndarray]:
        m = self.m
        tokens, bounds = _tokens(t)
        names, ids = np.unique(tokens, return_inverse=True)
        count, left = self.word(names)
        base = np.log10((count + 0.5) / (m.tokens + 0.5 * (m.words + 1)))
        d = np.array(m.word_discounts)
        word = np.maximum(left - d[np.minimum(left, 3)], 0) / max(m.pairs, 1) + m.word_rest / (m.words + 1)
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[bounds[:-1]] = len(names)
        codes, at = np.unique((before.astype(U) << U(32)) | ids.astype(U), return_inverse=True)
        last = (codes & U(0xFFFFFFFF)).astype(np.int64)
        n, stats = self.pair(np.append(names, BEGIN)[(codes >> U(32)).astype(np.int64)], names[last])
        d = np.array(m.pair_discounts)
        total = np.maximum(stats[:, 0], 1)
        rest = np.where(stats[:, 0] > 0, (stats[:, 1:] @ d[1:]) / total, 1.0)
        p = np.log10(np.maximum(n - d[np.minimum(n, 3)], 0) / total + rest * word[last])
        sums = lambda x: np.add.reduceat(x, bounds[:-1])
        return {"n_tokens": np.diff(bounds), "n_known": sums((count > 0)[ids].astype(np.int64)), "base_score": sums(base[ids]), "score": sums(p[at])}


def score(docs: DataFrame, m: Model) -> DataFrame:
    """doc_id with n_tokens, n_known, base_score and score (log10 probabilities) of each whole text, its end included.

    A null or empty text is its end alone. Workers map the model's arrays; a chunk looks its distinct words and pairs
    up in order, so that pages are read once. Repeated rows have a row each; no rows give none; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(m)
        try:
            for b in batches:
                for t in W.texts(b["text"], CHUNK):
                    x = own.score(t)
                    ids = b["doc_id"].slice(t.rows.start, len(t.bounds) - 1)
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(x[k], kind) for k, kind in (("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())))], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])
        finally:
            own.maps.close()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
