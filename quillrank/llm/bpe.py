"""BPE encoding and decoding; long unsplit texts are encoded in pieces and concatenated as a tree."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrank.llm import _words as W
from quillrank.llm._columns import packed, unpacked

#: Code points up to which a text is encoded in one go.
PIECE = 1 << 16
#: Words whose ids a worker remembers before it starts anew.
REMEMBERED = 64_000
#: Words that are encoded at once.
AT_ONCE = 8_192
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
_MARKS = r"!-&(-/:;=?@\[-`{}~"
#: Latin letters, then marks or nothing.
_LATIN = re.compile(f"([{_LETTERS}]+)([{_MARKS}]*)")


class Codec:
    """A tokenizer file, with the ids of the words seen lately.

    For a tokenizer that drops white space and never joins over it, a text's ids are its words' ids in order; this
    is tried once on load, and other tokenizers encode whole texts. If moreover every Latin letter and every mark
    passes a trial, such words skip the tokenizer's patterns: letters go to the same merges in lower case, many words
    at a time, and the marks after them are encoded on their own.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.plain = self.tok.decoder is None
        self.vocab = {i: t for t, i in self.tok.get_vocab(with_added_tokens=True).items()}
        probe = ["Ab c", "'s 12 !?", "é", "x"]
        self.by_word = self._raw("  \n".join(probe)) == sum((self._raw(w) for p in probe for w in p.split()), [])
        self.seen: dict[bytes, bytes] = {}
        # the model is shared, not loaded twice
        self.bare = Tokenizer(self.tok.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = getattr(self.tok.model, "end_of_word_suffix", None)
        self.last = np.array([bool(suffix) and self.vocab.get(i, "").endswith(suffix) for i in range(max(self.vocab, default=-1) + 1)])
        self.suffix = suffix

    @cached_property
    def latin(self) -> bool:
        if not self.by_word or not self.suffix:
            return False
        letters = [c for c in map(chr, range(0x250)) if re.match(f"[{_LETTERS}]", c)]
        marks = [c for c in map(chr, range(0x80)) if re.match(f"[{_MARKS}]", c)]
        words = [f"{a}{c}{b}" for c in letters for a, b in (("", ""), ("a", "a"), ("Z", "é"))]
        runs = [*marks, *(a + b for a in marks for b in marks)]
        same = self._letters([w.lower() for w in words]) == self._full(words)
        head = self._full(["ab"])[0]
        return same and self._full([f"ab{r}" for r in runs]) == [head + x for x in self._full(runs)]

    def _full(self, texts: list[str]) -> list[bytes]:
        found = self.tok.encode_batch_fast(texts, add_special_tokens=False)
        return [struct.pack(f"<{len(x)}I", *x) for x in (e.ids for e in found)]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of lower-case words of letters: encoded in long runs, and cut after each token that ends a word."""
        runs = [" ".join(words[i : i + 256]) for i in range(0, len(words), 256)]
        ids = np.array([i for e in self.bare.encode_batch_fast(runs, add_special_tokens=False) for i in e.ids], dtype="<u4")
        ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist() if len(ids) else []
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _learn(self, words: list[bytes]) -> None:
        texts = [w.decode() for w in words]
        cut = [_LATIN.fullmatch(t) if self.latin else None for t in texts]
        other = [t for t, m in zip(texts, cut, strict=True) if m is None]
        other += {m[2] for m in cut if m} - {"", *other}
        self.seen.update(zip((t.encode() for t in other), self._full(other), strict=True))
        letters = list({m[1].lower() for m in cut if m})
        found = dict(zip(letters, self._letters(letters), strict=True))
        self.seen.update((w, found[m[1].lower()] + (self.seen[m[2].encode()] if m[2] else b"")) for w, m in zip(words, cut, strict=True) if m)

    def lengths(self, words: list[bytes]) -> list[int]:
        """Numbers of ids of texts, which are words if white space is dropped."""
        if self.by_word:
            self.seen.clear()
            self._learn(words)
            return [len(self.seen[w]) // 4 for w in words]
        return [len(x) for x in self.tok.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

    def _raw(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if not self.by_word:
            return self._full(texts)
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        words = [t.encode().split() for t in texts]
        new = list({w for ws in words for w in ws if w not in self.seen})
        for i in range(0, len(new), AT_ONCE):
            self._learn(new[i : i + AT_ONCE])
        get = self.seen.__getitem__
        return [b"".join(map(get, ws)) for ws in words]

    def text(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, dtype="<u4").tolist()
        if self.plain:
            return " ".join(map(self.vocab.__getitem__, numbers))
        return self.tok.decode(numbers, skip_special_tokens=False)

    def spans(self, text: str, at: int) -> np.ndarray:
        """Rows of (id, start, end), in code points from `at` on."""
        if not self.by_word:
            x = self.tok.encode(text, add_special_tokens=False)
            return np.array([(i, a + at, b + at) for i, (a, b) in zip(x.ids, x.offsets, strict=True)], dtype=np.int64).reshape(-1, 3)
        starts, words = [], []
        for m in _WORD.finditer(text):
            starts.append(m.start() + at)
            words.append(m.group())
        out = [(i, a + s, b + s) for x, s in zip(self.tok.encode_batch(words, add_special_tokens=False), starts, strict=True) for i, (a, b) in zip(x.ids, x.offsets, strict=True)]
        return np.array(out, dtype=np.int64).reshape(-1, 3)

    def join(self, left: np.ndarray, right: np.ndarray, text: str, bounds: tuple[int, int], window: int = 8) -> np.ndarray:
        """Ids of two neighbouring pieces of `text` as ids of both together.

        A window of so many tokens on either side of the join is encoded anew, and doubled until it begins with two
        of the left piece's own tokens and ends with two of the right's, at the same places, or has reached the
        pieces' ends. Every pair of neighbours in what comes out then stands so in the encoding of some text that
        holds the same characters around it, and BPE's merges depend on no more than that.
        """
        agree = 2
        while True:
            whole_left, whole_right = window >= len(left), window >= len(right)
            a = bounds[0] if whole_left else int(left[-window, 1])
            b = bounds[1] if whole_right else int(right[window - 1, 2])
            mid = self.spans(text[a:b], a)
            fine = (whole_left or np.array_equal(mid[:agree], left[-window : len(left) - window + agree])) and (whole_right or np.array_equal(mid[len(mid) - agree :], right[window - agree : window]))
            if fine and len(mid) >= agree or whole_left and whole_right:
                return np.concatenate([left[:0] if whole_left else left[:-window], mid, right[:0] if whole_right else right[window:]])
            window *= 2


@lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    return Codec(path)


def _added(back: bool) -> str:
    return "ids binary, decoded string" if back else "ids binary"


def _whole(path: str, back: bool):
    # a codec a task: workers that go on to other work don't keep its words
    @F.arrow_udf(T.StructType.fromDDL(_added(back)))
    def encode_whole(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Codec(path)
        for column in columns:
            out: list[bytes] = []
            values = column.fill_null("")
            for i in range(0, len(values), 256):
                out += own.ids(values.slice(i, 256).to_pylist())
            found = {"ids": pa.array(out, pa.binary())} | ({"decoded": pa.array(map(own.text, out), pa.string())} if back else {})
            yield pa.StructArray.from_arrays(list(found.values()), names=list(found))
            pa.default_memory_pool().release_unused()

    return encode_whole


def _cut(piece: int):
    """Halves of halves of long texts, until none is longer than `piece`: (key, nth, of, at, piece) of each."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                text = b["text"][i].as_py()
                n = 1
                while -(-len(text) // n) > piece:
                    n *= 2
                cuts = [len(text) * k // n for k in range(n + 1)]
                for lo in range(0, n, 64):
                    part = range(lo, min(lo + 64, n))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b["key"][i].as_py()] * len(part), pa.string()), pa.array(part, pa.int32()), pa.array([n] * len(part), pa.int32()),
                         pa.array([cuts[k] for k in part], pa.int32()), pa.array([text[cuts[k] : cuts[k + 1]] for k in part], pa.string())],
                        names=["key", "nth", "of", "at", "piece"],
                    )

    return cut


def _pieces(path: str):
    def encode_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codec(path)
        for b in batches:
            found = [own.spans(t, a).astype("<i4").tobytes() for t, a in zip(b["piece"].to_pylist(), b["at"].to_pylist(), strict=True)]
            yield b.append_column("spans", pa.array(found, pa.binary()))

    return encode_pieces


def _concatenate(path: str, back: bool):
    def tree(group: pa.Table) -> pa.Table:
        own = codec(path)
        group = group.sort_by("nth")
        texts, of = group["piece"].to_pylist(), group["of"][0].as_py()
        if len(texts) != of:
            raise RuntimeError(f"{len(texts)} of {of} pieces of a text")
        text = "".join(texts)
        cuts = [0, *np.cumsum([len(t) for t in texts]).tolist()]
        level = [(np.frombuffer(s, dtype="<i4").reshape(-1, 3).astype(np.int64), cuts[i], cuts[i + 1]) for i, s in enumerate(group["spans"].to_pylist())]
        while len(level) > 1:
            level = [(own.join(x[0], y[0], text, (x[1], y[2])), x[1], y[2]) for x, y in zip(level[::2], level[1::2], strict=False)] + level[len(level) // 2 * 2 :]
        ids = level[0][0][:, 0].astype("<u4").tobytes()
        found = {"key": group["key"][:1], "ids": pa.array([ids], pa.binary())}
        return pa.table(found | ({"decoded": pa.array([own.text(ids)], pa.string())} if back else {}))

    return tree


def _in_pieces(rows: DataFrame, path: str, piece: int, back: bool) -> DataFrame:
    """(row, ids and maybe decoded) of rows (row, text) with long texts."""
    rows = rows.withColumn("key", F.sha2("text", 256))
    texts = rows.groupBy("key").agg(F.first("text").alias("text"))
    pieces = texts.mapInArrow(_cut(piece), "key string, nth int, of int, at int, piece string").repartition(F.col("key"), F.col("nth"))
    spans = pieces.mapInArrow(_pieces(path), "key string, nth int, of int, at int, piece string, spans binary")
    merged = spans.groupBy("key").applyInArrow(_concatenate(path, back), f"key string, {_added(back)}")
    return rows.select("row", "key").join(merged, "key").select("row", *(["ids", "decoded"] if back else ["ids"]))


def encode(docs: DataFrame, path: str, piece: int = PIECE, back: bool = False) -> DataFrame:
    """Every row of `docs` with `ids`: the whole text's token ids, packed as little-endian unsigned 32-bit integers.

    Texts of up to `piece` code points are encoded where they are; a null text is empty and has no ids. Longer ones
    are halved until the pieces are that short, wherever the cuts fall, pieces are encoded in tasks of their own, and
    neighbours are joined pairwise level by level (see Codec.join), which encodes a few tokens a join anew. What joins a
    text holds its pieces and its ids, as the row that comes out does. Only long texts are shuffled, equal ones once:
    they are known by their SHA-256, which is the same whenever a lost task runs again. Repeated rows each have their
    own ids. Other columns stay, whatever their names; ones called `ids`, or `decoded` with `back`, give way. No rows
    give none. `path` is a tokenizer file that all workers can read. With `back`, `decoded` is the text that the ids
    stand for, decoded by the worker that has them.
    """
    added = ["ids", "decoded"] if back else ["ids"]
    rows = packed(docs, text=F.col("text"))
    long = F.coalesce(F.length("text") > piece, F.lit(False))
    short = rows.where(~long).select("row", _whole(path, back)(F.col("text")).alias("found")).select("row", *(F.col("found")[c].alias(c) for c in added))
    both = short.unionByName(_in_pieces(rows.where(long), path, piece, back))
    return unpacked(both, docs.columns, **{c: F.col(c) for c in added})


class Lengths:
    """How many ids each unit of a text has: units are words where white space is dropped, and else words with the
    spaces and line feeds before them, over which no token reaches. Units met before are known by a 64-bit hash."""

    MOST = 4_000_000

    def __init__(self, path: str):
        self.codec = Codec(path)
        self.h, self.n = np.empty(0, dtype=W.U), np.empty(0, dtype=np.int64)
        probe = "a  b\n\nc \n d, 'e  12.\n"
        self.spaced = not self.codec.by_word and sum(map(len, self.codec._full(re.findall(r"[ \n]*[^ \n]+|[ \n]+$", probe)))) == len(self.codec._full([probe])[0])

    def _odd(self, t: W.Texts) -> np.ndarray:
        """Texts with white space other than spaces and line feeds, which may join with those."""
        d = np.concatenate([t.data, np.zeros(2, dtype=np.uint8)])
        x, y, z = d[:-2], d[1:-1], d[2:]
        odd = ((x >= 0x09) & (x <= 0x0D) & (x != 0x0A)) | ((x >= 0x1C) & (x <= 0x1F)) | ((x == 0xC2) & ((y == 0x85) | (y == 0xA0)))
        odd |= (x == 0xE1) & (y == 0x9A) & (z == 0x80) | (x == 0xE3) & (y == 0x80) & (z == 0x80) | (x == 0xE2) & (y == 0x81) & (z == 0x9F)
        odd |= (x == 0xE2) & (y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))
        return np.diff(np.searchsorted(np.flatnonzero(odd), t.bounds)) > 0

    def _known(self, t: W.Texts, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = W.hashes(t.data, starts, ends)
        names, first, ids = np.unique(h, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.h, names), max(len(self.h) - 1, 0))
        new = np.ones(len(names), dtype=bool) if not len(self.h) else self.h[at] != names
        if new.any():
            if len(self.h) > self.MOST:
                self.h, self.n, new = self.h[:0], self.n[:0], np.ones(len(names), dtype=bool)
            raw = t.data.tobytes()
            found: list[int] = []
            words = [raw[starts[i] : ends[i]] for i in first[new]]
            for i in range(0, len(words), AT_ONCE):
                found += self.codec.lengths(words[i : i + AT_ONCE])
            h, n = np.concatenate([self.h, names[new]]), np.concatenate([self.n, np.array(found, dtype=np.int64)])
            order = np.argsort(h, kind="stable")
            self.h, self.n = h[order], n[order]
        return self.n[np.searchsorted(self.h, names)][ids]

    def of(self, t: W.Texts) -> np.ndarray:
        starts, ends = W.segments(t.data, t.bounds, W.SPACE)
        bounds = np.searchsorted(starts, t.bounds)
        if self.spaced:
            # a unit begins where the one before it ends, or its text does
            last = np.maximum.reduce([ends[np.maximum(bounds[1:] - 1, 0)] if len(ends) else t.bounds[:-1], t.bounds[:-1]])
            tail = np.where(bounds[1:] > bounds[:-1], last, t.bounds[:-1])
            begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            full = np.flatnonzero(bounds[1:] > bounds[:-1])
            begins[bounds[:-1][full]] = t.bounds[:-1][full]
            more = np.flatnonzero(tail < t.bounds[1:])
            starts, ends = np.concatenate([begins, tail[more]]), np.concatenate([ends, t.bounds[1:][more]])
            order = np.argsort(starts, kind="stable")
            starts, ends = starts[order], ends[order]
            bounds = np.searchsorted(starts, t.bounds)
        n = self._known(t, starts, ends) if len(starts) else np.empty(0, dtype=np.int64)
        sums = np.concatenate([[0], np.cumsum(n)])
        return sums[bounds[1:]] - sums[bounds[:-1]]

    def all(self, column: pa.Array) -> np.ndarray:
        out = []
        for t in W.texts(column, 1 << 20):
            n = self.of(t) if self.spaced or self.codec.by_word else np.zeros(len(t.bounds) - 1, dtype=np.int64)
            for i in np.flatnonzero(self._odd(t)) if self.spaced else range(0 if self.codec.by_word else len(n)):
                n[i] = len(self.codec._full([t.data[t.bounds[i] : t.bounds[i + 1]].tobytes().decode()])[0]) // 4
            out.append(n)
        return np.concatenate(out) if out else np.empty(0, dtype=np.int64)


def _lengths(paths: list[str]):
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def lengths(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = [Lengths(p) for p in paths]
        for column in columns:
            each = np.stack([x.all(column) for x in own], axis=1)
            yield pa.ListArray.from_arrays(np.arange(len(column) + 1, dtype=np.int32) * len(own), pa.array(each.ravel(), pa.int64()))

    return lengths


def count(docs: DataFrame, paths: dict[str, str], piece: int = PIECE) -> DataFrame:
    """Every row of `docs` once for each tokenizer of `paths`, with its name there as `tokenizer_version` and `n_tokens`:
    how many ids `encode` gives the whole text, without keeping them. All are counted in one pass.

    Nulls, long texts, repeated rows and other columns are as in `encode`; columns of these two names give way.
    """
    rows = packed(docs, text=F.col("text"))
    long = F.coalesce(F.length("text") > piece, F.lit(False))
    ns = rows.where(~long).select("row", _lengths(list(paths.values()))(F.col("text")).alias("ns"))
    both = ns.select("row", F.inline(F.array(*(F.struct(F.lit(v).alias("version"), F.col("ns")[i].alias("n")) for i, v in enumerate(paths)))))
    for v, path in paths.items():
        pieces = _in_pieces(rows.where(long), path, piece, False)
        both = both.unionByName(pieces.select("row", F.lit(v).alias("version"), F.call_function("div", F.octet_length("ids"), F.lit(4)).cast("long").alias("n")))
    return unpacked(both, docs.columns, tokenizer_version=F.col("version"), n_tokens=F.col("n"))


def decode(ids: Column, path: str) -> Column:
    """The text of packed ids, special tokens included."""

    @F.arrow_udf(T.StringType())
    def decoded(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Codec(path)
        for column in columns:
            yield pa.array([own.text(x or b"") for x in column.to_pylist()], pa.string())

    return decoded(ids)
