"""Runs of repeated words against every period tried at every place."""

from __future__ import annotations

import hashlib

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillrank.llm import periodic, queries


def found(docs):
    ids, bounds = np.concatenate([np.array(d, dtype=np.int64) for d in docs]), np.cumsum([0, *map(len, docs)])
    start, end, q = periodic.runs(ids, bounds)
    own = np.searchsorted(bounds, start, side="right") - 1
    return [sorted((int(a - bounds[d]), int(z - a), int(p)) for a, z, p, o in zip(start, end, q, own, strict=True) if o == d) for d in range(len(docs))]


pieces = st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=6), st.integers(1, 9)), max_size=8)
texts = st.lists(pieces.map(lambda x: [w for own, n in x for w in own * n]), min_size=1, max_size=5)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_runs(docs):
    assert found(docs) == [brute.word_runs(d) for d in docs]


@settings(max_examples=60, deadline=None)
@given(texts, st.integers(0, 3))
def test_runs_where_hashes_deceive(docs, bits):
    """Prefix hashes of so few bits that most comparisons say equal: words decide."""

    def same(self, a, p, n, whole=periodic._Prefix.same):
        low = np.uint64((1 << bits) - 1)
        return whole(self, a, p, n) | (((self.sums[a + n] - self.sums[a]) * self.up[p] ^ (self.sums[a + p + n] - self.sums[a + p])) & low == 0)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(periodic._Prefix, "same", same)
        assert found(docs) == [brute.word_runs(d) for d in docs]


def test_sequences_that_deceive_any_polynomial_hash(monkeypatch):
    """A Thue-Morse sequence and its complement have one hash modulo 2**64; blocks of pairs are small, too."""
    monkeypatch.setattr(periodic, "PAIRS", 1_000)
    a = np.array([bin(i).count("1") & 1 for i in range(2_048)])
    doc = np.concatenate([a, 1 - a, a, 1 - a, np.tile(a[:300], 5), [7] * 50])
    assert found([doc.tolist()]) == [brute.word_runs(doc.tolist())]


def test_query(spark, data):
    """All documents, a tenth with planted stretches."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    check({r.doc_id: r.text for r in docs}, queries.op12_periodic_runs(spark, data).collect())


EDGES = {0: None, 1: "", 2: " \n\t ", 3: "a " * 5, 4: "a " * 6, 5: "a b " * 4, 6: "a b a b a b a", 7: "ü  ü\nü\tü ü ü x", 8: "a b c " * 40_000 + "x " * 90_000, 9: "x a a a a a a y y y y y y y"} | {i: "p q r s t " * i for i in range(10, 60)}


def test_edges(spark, tmp_path):
    spark.createDataFrame(list(EDGES.items()), "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source", "1L n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    check({i: t for i, t in EDGES.items() if i != 8}, [r for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect() if r.doc_id != 8])


def test_very_long_text_nulls_and_repeated_rows(spark):
    rows = [(None, None, 1), (1, EDGES[8], 2), (1, EDGES[8], 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = docs.select("doc_id", "runs", periodic.periodic_runs(docs.text).alias("f")).collect()
    assert [r.runs for r in got] == [1, 2, 2] and got[0].f == (0, [], "")
    assert [tuple(x) for x in got[1].f.runs] == [(0, 120_000, 3), (120_000, 90_000, 1)] and got[1].f.collapsed == "a b c x" and got[2].f == got[1].f
    assert docs.limit(0).select(periodic.periodic_runs(docs.text)).count() == 0


def check(texts, got):
    assert len(got) == len(texts)
    n = 0
    for r in got:
        words = brute.planted(r.doc_id, texts[r.doc_id])
        runs = brute.word_runs(words)
        n += len(runs)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == brute.sha("".join(f"{a},{x},{p}\n" for a, x, p in runs))
        assert r.collapsed_sha256 == hashlib.sha256(brute.collapsed(words, runs).encode()).hexdigest()
    assert n > 0
