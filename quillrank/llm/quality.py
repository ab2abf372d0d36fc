"""Quality rules with thresholds that follow each language and source."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrank.llm import _words as W
from quillrank.llm._columns import packed, unpacked

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
FIELDS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _later(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes occurred earlier in the same document, and which occur twice or more."""
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(owner[order], kind="stable")]
    same = np.zeros(len(h) + 1, dtype=bool)
    same[1:-1] = (h[order][1:] == h[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    later, twice = np.zeros(len(h), dtype=bool), np.zeros(len(h), dtype=bool)
    later[order], twice[order] = same[:-1], same[:-1] | same[1:]
    return later, twice


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """The fields of each text; a null or empty text has zeros."""
    out = {k: [] for k in FIELDS}
    for t in W.texts(column):
        starts, ends = W.segments(t.data, t.bounds, W.SPACE)
        words, bounds = W.hashes(t.data, starts, ends), np.searchsorted(starts, t.bounds)
        found, first = W.windows(words, bounds, 3)
        covered = np.zeros(len(words) + 3, dtype=bool)
        at = first[_later(found, W.owners(bounds)[first])[1]]
        for k in range(3):
            covered[at + k] = True
        line_at, line_end = W.segments(t.data, t.bounds, W.NEWLINE)
        full = np.add.reduceat(~W.SPACE[t.data], line_at) > 0 if len(line_at) else np.empty(0, dtype=bool)
        line_at, line_end = line_at[full], line_end[full]
        line_bounds = np.searchsorted(line_at, t.bounds)
        again, _ = _later(W.hashes(t.data, line_at, line_end), W.owners(line_bounds))
        chars = ((t.data & 0xC0) != 0x80) & ~W.SPACE[t.data]
        for k, v in (
            ("n_words", np.diff(bounds)), ("word_chars", _sums(chars, t.bounds)), ("n_symbols", _sums(SYMBOLS[t.data], t.bounds)),
            ("n_lines", np.diff(line_bounds)), ("n_dup_lines", _sums(again, line_bounds)), ("n_repeat_words", _sums(covered[: len(words)], bounds)),
        ):
            out[k].append(v)
    return {k: np.concatenate(v) if v else np.empty(0, dtype=np.int64) for k, v in out.items()}


def measured(text: Column) -> Column:
    """A struct of the fields of a text."""

    @F.arrow_udf(T.StructType([T.StructField(k, T.LongType()) for k in FIELDS]))
    def fields(column: pa.Array) -> pa.Array:
        found = measure(column)
        return pa.StructArray.from_arrays([pa.array(found[k].astype(np.int64)) for k in FIELDS], names=FIELDS)

    return fields(text)


@dataclass(frozen=True)
class Fence:
    """How far a feature may lie out: its group's quantile at `level` per mille (for a low limit at 1000 - `level`), and
    beyond it `reach` times the way from the group's median to there. Nothing else decides: no count is given."""

    feature: str
    level: int
    reach: int
    low: bool = False


#: Features are whole numbers: per mille of words or lines, and hundredths of a character. Symbols and word lengths tell bad
#: texts apart, up to a fifth of a group, so their limits rest on the other four fifths; lines and words that repeat are
#: bad only where they are more than anything usual in the group's own last hundredth.
FENCES = [Fence("symbols", 800, 3), Fence("dup_lines", 990, 1), Fence("repeats", 990, 1), Fence("word_length", 800, 6, low=True)]


def sketched(fences: list[Fence]) -> list[str]:
    """What the thresholds are made from."""
    return [f.feature for f in fences]


def features() -> dict[str, Column]:
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    per = lambda a, k, b: F.call_function("div", F.col(a) * k, b)
    return {
        "symbols": per("n_symbols", 1000, words),
        "dup_lines": per("n_dup_lines", 1000, lines),
        "repeats": per("n_repeat_words", 1000, words),
        "word_length": per("word_chars", 100, words),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def cell(value: Column) -> Column:
    """The sketch's cell of a whole number >= 0: itself below 128, else its 7 leading bits (1/64 off at most)."""
    unit = F.pow(F.lit(2.0), F.greatest(F.length(F.bin(value)) - 7, F.lit(0))).cast("long")
    return value - value % unit


def sketch(found: DataFrame, names: list[str]) -> DataFrame:
    """Quantile sketches: counts by language, source, feature and cell. Sketches merge by adding counts.

    Cells are fixed, so that the result doesn't depend on order, retries or partitioning; there are under 4,000 a
    feature. Counting starts before the shuffle, so that a hot source sends a row a cell and task.
    """
    long = found.select("lang", "source", F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).alias("v")) for n in names))).alias("f"))
    return long.groupBy("lang", "source", F.col("f.feature").alias("feature"), cell(F.col("f.v")).alias("cell")).agg(F.count("*").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str], fences: list[Fence]) -> DataFrame:
    """Cells of the lower tail, the median and the upper tail of the sketches merged by `keys`, each feature's at its fence's
    level, with the number of documents in each."""
    by = [*keys, "feature"]
    merged = sketches.groupBy(*by, "cell").agg(F.sum("n").alias("n"))
    line = Window.partitionBy(*by).orderBy("cell")
    level = F.create_map(*(F.lit(x) for f in fences for x in (f.feature, f.level)))[F.col("feature")]
    ranked = merged.withColumns({"upto": F.sum("n").over(line), "all": F.sum("n").over(Window.partitionBy(*by)), "level": level})
    at = lambda mille: F.min(F.when(1000 * F.col("upto") >= mille * F.col("all"), F.col("cell")))
    return ranked.groupBy(*by).agg(F.max("all").alias("docs"), F.array(at(1000 - F.col("level")), at(F.lit(500)), at(F.col("level"))).alias("q"))


def thresholds(sketches: DataFrame, fences: list[Fence] = FENCES, least_docs: int = 30) -> DataFrame:
    """low_<feature> and high_<feature>, cells both, for each language and source, all from its own sketches.

    A group of fewer than `least_docs` documents takes its language's merged sketch, or all documents' if that is
    small too.
    """
    levels = [quantiles(sketches, k, fences) for k in (["lang", "source"], ["lang"], [])]
    own, lang, whole = (q.select(*q.columns[:-2], F.col("docs").alias(f"d{i}"), F.col("q").alias(f"q{i}")) for i, q in enumerate(levels))
    lang, whole = lang.withColumnsRenamed({"lang": "l1", "feature": "f1"}), whole.withColumnRenamed("feature", "f2")
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("l1")) & (F.col("feature") == F.col("f1"))).join(whole, F.col("feature") == F.col("f2"))
    q = F.when(F.col("d0") >= least_docs, F.col("q0")).when(F.col("d1") >= least_docs, F.col("q1")).otherwise(F.col("q2"))
    of = lambda n: F.max(F.when(F.col("feature") == n, F.col("q"))).alias(n)
    placed = joined.withColumn("q", q).groupBy("lang", "source").agg(*map(of, sketched(fences)))
    limits = []
    for f in fences:
        low, middle, high = (F.col(f.feature)[i] for i in range(3))
        limits.append((high + f.reach * (high - middle)).alias(f"high_{f.feature}"))
        if f.low:
            limits.append((low - f.reach * (middle - low)).alias(f"low_{f.feature}"))
    return placed.select("lang", "source", *limits)


def judge(found: DataFrame, limits: DataFrame, fences: list[Fence] = FENCES) -> DataFrame:
    """Join each document's fields with its group's thresholds and add `kept`. Values are compared by their cells, as the
    limits are made of cells."""
    t = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    near = found.join(t, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")))
    fine = ~F.col("base_failed")
    for f in fences:
        fine &= cell(F.col(f.feature)) <= F.col(f"high_{f.feature}")
        if f.low:
            fine &= cell(F.col(f.feature)) >= F.col(f"low_{f.feature}")
    return near.withColumn("kept", fine).drop(*t.columns)


def with_fields(docs: DataFrame) -> DataFrame:
    """doc_id, lang and source with the measured fields, the features and base_failed."""
    m = docs.select("doc_id", "lang", "source", measured(F.col("text")).alias("_m")).select("doc_id", "lang", "source", *(F.col(f"_m.{k}").alias(k) for k in FIELDS))
    return m.withColumns(features() | {"base_failed": base_failed()})


def filter_docs(docs: DataFrame, save, fences: list[Fence] = FENCES) -> DataFrame:
    """The documents that the rules keep, with all their columns.

    `save` writes a table to shared storage and reads it back. Thresholds are gathered over documents that pass the
    fixed base rules, so that what fails anyway doesn't move them. Texts are measured once for the sketches and once
    for the filter, which costs less than shuffling them to meet their fields. A null text has no words and goes;
    null languages and sources are groups of their own; repeated rows are judged each; no rows give none. Other columns
    are carried along in a struct, whatever their names.
    """
    limits = save(thresholds(sketch(with_fields(docs).where(~F.col("base_failed")), sketched(fences)), fences), "limits")
    row = packed(docs, lang=F.col("lang"), source=F.col("source"), m=measured(F.col("text")))
    row = row.select("row", "lang", "source", *(F.col(f"m.{k}").alias(k) for k in FIELDS)).withColumns(features() | {"base_failed": base_failed()})
    return unpacked(judge(row, limits, fences).where("kept"), docs.columns)
