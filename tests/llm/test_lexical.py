"""Inverted treaps, and the ranked search over them against every document's score."""

from __future__ import annotations

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillrank.llm import lexical
from quillrank.llm._scratch import Scratch


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 50), max_size=20, unique=True), min_size=1, max_size=6))
def test_treaps(lists):
    bounds = np.cumsum([0, *map(len, lists)])
    root, left, right = lexical.treaps(bounds, np.array([x for own in lists for x in own], dtype=np.uint64))

    def walk(own, base, at):
        if at < 0:
            return []
        for child in (left[base + at], right[base + at]):
            assert child < 0 or own[child] < own[at]
        return walk(own, base, left[base + at]) + [int(at)] + walk(own, base, right[base + at])

    tops = iter(root)
    for own, base in zip(lists, bounds, strict=False):
        if own:
            top = next(tops)
            assert own[top] == max(own) and walk(own, base, top) == list(range(len(own)))


ITEMS = [(1, "Apple pear ü-Üx"), (2, None), (3, ""), (4, "pear pear PEAR"), (5, "absent words"), (6, "a1 b2"), (6, "a1 b2"), (None, "apple")]
DOCS = [(1, "apple apple pear"), (2, "apple"), (3, None), (4, "...!"), (5, "PEAR, ü; a1"), (5, "PEAR, ü; a1"), (None, "apple"), (None, "b2 apple"), (7, "b2 " * 70_000 + "apple pear"), (8, "Üx ü Üx")] + [(100 + i, "pear plum") for i in range(40)]


def searched(spark, docs, items, k=10):
    scratch = Scratch(spark, "lexical")
    index = lexical.build(spark.createDataFrame(docs, "doc_id long, text string").withColumn("term", lexical.F.lit("own")).repartition(3), scratch)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("query", lexical.F.lit("own"))
    return sorted(map(tuple, lexical.search(index, asked, scratch, k).collect()), key=repr)


@pytest.mark.parametrize(("shard", "k"), [(1 << 24, 10), (30, 3), (200, 1)])
def test_ranks(spark, monkeypatch, shard, k):
    """Shards of a few documents, ties, null and repeated ids, terms beyond ASCII, texts without terms."""
    monkeypatch.setattr(lexical, "SHARD", shard)
    monkeypatch.setattr(lexical, "QUERIES", 3)
    assert searched(spark, DOCS, ITEMS, k) == sorted(brute.lexical(DOCS, ITEMS, k), key=repr)


def test_every_pruned_document_is_too_low(spark, monkeypatch):
    """Many documents of skewed words: few are scored, and the ranks are those of all."""
    monkeypatch.setattr(lexical, "FEW", 2)
    rng = np.random.default_rng(5)
    docs = [(int(i), " ".join(f"w{x}" for x in rng.zipf(1.3, 30) % 500)) for i in rng.permutation(3_000)]
    items = [(i, " ".join(f"w{x}" for x in rng.zipf(1.2, 6) % 500)) for i in range(20)]
    assert searched(spark, docs, items) == sorted(brute.lexical(docs, items, 10), key=repr)


def test_traversal_skips_most_documents():
    rng = np.random.default_rng(6)
    n, lists = 20_000, []
    for df in (15_000, 6_000, 40):
        lists.append(np.sort(rng.choice(n, df, replace=False)))
    at, bounds = np.concatenate(lists), np.cumsum([0, *map(len, lists)])
    impact = rng.integers(1, 1_000_000, len(at))
    root, left, right = lexical.treaps(bounds, (impact.astype(np.uint64) << np.uint64(32)) | at.astype(np.uint64))
    base = np.repeat(bounds[:-1], np.diff(bounds))
    t = lexical._Treaps(at, impact, np.where(left < 0, -1, left + base), np.where(right < 0, -1, right + base), {w: int(r + b) for w, r, b in zip("abc", root, bounds, strict=False)}, np.arange(n), np.ones(n, dtype=bool))

    class Best(lexical._Best):
        seen = 0

        def add(self, score, ids, known):
            Best.seen += len(ids)
            super().add(score, ids, known)

    best = Best(10)
    t.search([("a", 100), ("b", 2_000), ("c", 6_000), ("d", 9)], best)
    score = np.zeros(n, dtype=np.int64)
    for own, w in zip(np.split(np.arange(len(at)), bounds[1:-1]), (100, 2_000, 6_000), strict=True):
        score[at[own]] += impact[own] * w
    want = np.lexsort((np.arange(n), -score))[:10]
    assert best.ids.tolist() == want.tolist() and best.score.tolist() == score[want].tolist() and Best.seen < n // 10


def test_no_rows(spark):
    assert searched(spark, [], ITEMS) == [] and searched(spark, DOCS, []) == []
