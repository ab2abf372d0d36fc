"""Counting quotient filters, and exact duplicates with fingerprints that clash."""

from __future__ import annotations

from collections import Counter

import brute
import numpy as np
import pytest

from quillrank.llm import exact
from quillrank.llm.exact import CountingQuotientFilter as Filter


@pytest.mark.parametrize("bits", [4, 9, 40, 64])
def test_filters_hold_and_merge_all_fingerprints(bits):
    rng, filters, want = np.random.default_rng(bits), [], Counter()
    for n in (0, 1, 700, 3_000):
        values = rng.integers(0, 1 << bits, n, dtype=np.uint64)
        values = np.concatenate([values, values[: n // 3]])
        want.update(values.tolist())
        f = Filter.of(*exact._summed(values, np.ones(len(values), dtype=np.int64)), bits)
        again = Filter.loaded(bits, f.quotient_bits, *f.stored(), len(f.remainders))
        assert dict(zip(*map(np.ndarray.tolist, again.read()), strict=True)) == Counter(values.tolist())
        filters.append(again)
    values, counts = Filter.merged(filters).read()
    assert (np.diff(values.astype(object)) > 0).all() and dict(zip(values.tolist(), counts.tolist(), strict=True)) == want


ROWS = [(1, "Same Text"), (5, "same text"), (3, "SAME TEXT"), (2, "Ä"), (4, "ä"), (6, None), (7, ""), (None, "x y"), (8, "x y"), (9, "alone"), (9, "twice"), (9, "twice"), (None, "n"), (None, "n"), (10, "w " * 100_000), (11, "W " * 100_000), (12, "w " * 99_999)]


@pytest.mark.parametrize("bits", [2, 64])
def test_groups(spark, bits):
    """With two bits nearly all texts share a fingerprint: whole texts decide."""
    docs = spark.createDataFrame([(i, t, "own") for i, t in ROWS], "doc_id long, text string, sha string").repartition(3)
    got = exact.exact_duplicates(docs, bits).collect()
    groups: dict = {}
    for i, t in ROWS:
        groups.setdefault(brute.lower(t or ""), []).append(i)
    want = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), brute.sha(t)) for i in ids]
    plain = lambda rows: sorted(rows, key=repr)
    assert plain((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == plain(want)
    for t, ids in groups.items():
        kept = [r.doc_id for r in got if r.text_sha256 == brute.sha(t) and r.kept]
        assert kept == [max((i for i in ids if i is not None), default=None)]


def test_no_rows(spark):
    assert exact.exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
