"""Slots for models of the caller's: encoders of texts, and taggers of entities over windows of words."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.functions import text as X

#: Makes a model in a worker: a list of texts to an array with a row each.
EncoderFactory = Callable[[], Callable[[list[str]], np.ndarray]]
#: Makes a tagger in a worker: a text to (word, label) pairs, in order.
TaggerFactory = Callable[[], Callable[[str], list[tuple[str, str]]]]


@lru_cache(maxsize=4)
def _made(factory: bytes):
    """A model is made once a worker process, which Spark uses for many tasks."""
    return cloudpickle.loads(factory)()


def encoded(text: Column, factory: EncoderFactory, batch: int = 32) -> Column:
    """The vector of a text, of unit length, from a model that is given `batch` texts at once. A null or empty text has a
    null vector, and so has one whose vector is zero."""
    packed = cloudpickle.dumps(factory)

    @F.pandas_udf("array<float>")
    def encode(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in columns:
            model, out = _made(packed), [None] * len(column)
            some = [i for i, t in enumerate(column) if t]
            for lo in range(0, len(some), batch):
                part = some[lo : lo + batch]
                x = np.asarray(model([column.iloc[i] for i in part]), dtype=np.float64)
                norm = np.linalg.norm(x, axis=1)
                for i, v, n in zip(part, x, norm, strict=True):
                    out[i] = (v / n).astype(np.float32) if n > 0 else None
            yield pd.Series(out)

    return encode(text)


def entities(rows: DataFrame, key: str, text: str, factory: TaggerFactory, size: int = 307, overlap: int = 38) -> DataFrame:
    """(key, entities: array of (word, label)) of every row: what a tagger finds in windows of `size` words, each of which
    shares `overlap` with the next, joined in the order of first occurrence. Entities whose words differ in case only are one
    with the first one's spelling; blank ones go. A window that the tagger fails on gives none; a text without words, or a
    null one, has an empty list. `key` tells rows apart."""
    packed = cloudpickle.dumps(factory)

    @F.pandas_udf("array<struct<word:string,label:string>>")
    def tag(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in columns:
            tagger, out = _made(packed), []
            for t in column:
                try:
                    out.append([{"word": w.strip(), "label": k or ""} for w, k in tagger(t) if w and w.strip()])
                except Exception:  # a model may fail in any way on a window, which then has no entities
                    out.append([])
            yield pd.Series(out)

    windows = rows.select(key, F.posexplode(X.word_windows(F.col(text), size, overlap)).alias("window", "words"))
    found = windows.select(key, "window", F.posexplode(tag("words")).alias("nth", "e"))
    first = found.groupBy(key, F.lower("e.word").alias("low"), F.col("e.label").alias("label")).agg(F.min(F.struct("window", "nth", F.col("e.word").alias("word"))).alias("at"))
    lists = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at.window", "at.nth", "at.word", "label"))).alias("es"))
    pairs = F.transform("es", lambda e: F.struct(e["word"].alias("word"), e["label"].alias("label")))
    return rows.select(key).join(lists, key, "left").select(key, F.coalesce(pairs, F.array().cast("array<struct<word:string,label:string>>")).alias("entities"))
