from __future__ import annotations

import math
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillrank.llm import _words, lm, neardup, queries, vectors
from quillrank.llm._graph import components
from quillrank.llm._scratch import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def near(spark, docs, p):
    rows = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), p).collect()
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}, {r.doc_id for r in rows if r.kept}


def test_near_duplicates_equal_brute_force(spark, data):
    docs = [(r.doc_id, r.text) for r in queries.documents(spark, data).collect()]
    want = brute.near_dups(docs, 3, 85)
    rows = queries.op3_near_duplicates(spark, data).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_near_duplicate_families(spark, monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    docs, k = [], 0
    for _ in range(4):
        base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
        for _ in range(40):
            words = list(base)
            for at in rng.integers(0, 120, rng.integers(0, 5)):
                words[at] = f"e{rng.integers(0, 5000)}"
            docs.append((k, " ".join(words)))
            k += 1
    docs += [(1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1004, "ONE  two"), (1005, "one"), (1006, "one two three"), (1007, docs[0][1]), (1008, "zz " * 30_000)]
    want = brute.near_dups(docs, 3, 85)
    got, kept = near(spark, docs, neardup.Near())
    assert got == want and kept == {i for i, (_, c) in want.items() if c == i}
    want5 = brute.near_dups(docs, 5, 80)
    assert near(spark, docs, neardup.Near(5, 80, 5, 40))[0] == want5


def test_near_duplicate_edges(spark):
    same = [(1, "a b c d"), (1, "a b c d"), (1, "p q r s"), (2, "p q r s"), (None, "x y z u"), (3, "x y z u")]
    rows = neardup.near_duplicates(spark.createDataFrame(same, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.component_id) for r in rows) == Counter({(1, 1): 3, (2, 1): 1, (None, 3): 1, (3, 3): 1})
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in same], DOCS)
    left = neardup.drop_duplicates(docs, neardup.Near(5, 80, 5, 40)).collect()
    assert sorted(r.doc_id for r in left) == [1, 3] and left[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars"}
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_one_row_of_each_component(spark):
    same = [(1, "a b c d"), (1, "A b  c d"), (1, "p q r s"), (2, "p q r s"), (None, "x y z u"), (3, "x y z u"), (None, "k l m n"), (None, "k l m n"), (None, "e f g h"), (None, None), (None, ""), (4, " "), (4, " "), (5, "v w x y"), (5, "a b c d")]
    docs = spark.createDataFrame([(i, t, "en", f"s{n}", n) for n, (i, t) in enumerate(same)], DOCS)
    left = neardup.one_of_each(docs, neardup.Near(5, 80, 5, 40)).collect()
    texts = Counter((r.doc_id, " ".join((r.text or "").lower().split())) for r in left)
    assert texts == Counter({(1, "a b c d"): 1, (1, "p q r s"): 1, (3, "x y z u"): 1, (None, "k l m n"): 1, (None, "e f g h"): 1, (None, ""): 2, (4, ""): 2, (5, "v w x y"): 1})
    assert all(same[r.n_chars] == (r.doc_id, r.text) and r.source == f"s{r.n_chars}" for r in left)
    assert neardup.one_of_each(docs.limit(0), neardup.Near()).count() == 0


def test_odd_sketch_estimates(spark):
    p, rng = neardup.Near(), np.random.default_rng(1)
    for share in (0.95, 0.85, 0.6):
        n = 2000
        both = int(share * 2 * n / (1 + share))
        x = rng.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64)
        h = np.concatenate([x[:n], x[-n:]])
        least = neardup._least(h, np.array([0, n, 2 * n]), p)
        a, b = neardup.odd_sketch(least)
        z = int(np.bitwise_count((a ^ b).view(np.uint64)).sum())
        assert abs(1 + neardup.BITS / (4 * p.samples) * math.log(1 - 2 * z / neardup.BITS) - share) < 0.15


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, 5000 + i) for i in range(1, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t"), "c").collect()}
    ids = {x for p in links for x in p if p[0] != p[1]}
    assert got == {k: v for k, v in brute.components(sorted(ids), links).items() if k in ids}


def test_embedding_links_equal_brute_force(spark, data):
    table = spark.read.parquet(f"{data}/embeddings.parquet").collect()
    want = brute.vector_links([(r.vec_id, r.embedding, r.label) for r in table], 0.93)
    got = {r.vec_id: (r.n_links, r.component_id) for r in queries.op5_embedding_duplicates(spark, data).collect()}
    assert got == want


def test_embedding_families_and_edges(spark, monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(vectors, "BLOCK", 32)
    rows, k = [], 0
    for label in (0, 1):
        base = rng.normal(size=(5, 16))
        for i in range(150):
            v = base[i % 5] + rng.normal(size=16) * (0.0 if i < 20 else 0.15)
            rows.append((k, [float(x) for x in v * rng.uniform(0.5, 2)], label))
            k += 1
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [float("nan")] + [1.0] * 15, 1), (904, [None] + [1.0] * 15, 1), (905, rows[0][1], None), (906, [1.0, 0.0], 1), (907, [2.0, 0.0], 1), (908, [1e300] * 16, 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = brute.vector_links(rows, 0.93)
    out = vectors.near_duplicates(frame).collect()
    got = {r.vec_id: (r.n_links, r.component_id) for r in out}
    assert got == want and sum(n for n, _ in want.values()) > 1000
    assert all(got[i] == (0, i) for i in range(900, 906)) and got[906] == (1, 906) and got[907] == (1, 906)
    again = vectors.near_duplicates(frame.unionByName(frame)).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in again) == Counter({(r.vec_id, r.n_links, r.component_id): 2 for r in out})
    assert vectors.near_duplicates(frame.limit(0)).count() == 0


@pytest.mark.parametrize(("dim", "axes"), [(64, 64), (256, 5), (768, 6)])
def test_no_link_is_lost_in_many_dimensions(spark, dim, axes):
    """Families whose members differ along all axes, or along a few that all of them share."""
    rng = np.random.default_rng(dim)
    base, shared = rng.normal(size=(60, dim)), rng.choice(dim, axes, replace=False)
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    spread, rows = rng.uniform(0.05, 0.3, 60), []
    for i in range(2400):
        x = base[i % 60].copy()
        x[shared] += spread[i % 60] * rng.normal(size=axes) / np.sqrt(axes)
        rows.append((i, [float(v) for v in x], 0))
    want = brute.vector_links(rows, 0.93)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == want and sum(n for n, _ in want.values()) > 20_000


def kneser_ney(train):
    """Interpolated modified Kneser-Ney, straight from its definition, over word strings: a function of a text."""
    tok = lambda t: [*brute.WORD.findall(brute.lower(t or "")), None]
    pairs = Counter((a, b) for t in train for a, b in zip(["<s>", *tok(t)], tok(t), strict=False))
    vocab = {b for _, b in pairs}
    left = Counter(b for _, b in pairs)
    d2 = lm.discounts(np.array([sum(v == k for v in pairs.values()) for k in (1, 2, 3, 4)]))
    d1 = lm.discounts(np.array([sum(v == k for v in left.values()) for k in (1, 2, 3, 4)]))
    total, rest, types = Counter(), Counter(), len(pairs)
    for (a, _), n in pairs.items():
        total[a] += n
        rest[a] += d2[min(n, 3)]
    spare = sum(d1[min(n, 3)] for n in left.values()) / types

    def score(text):
        out, before = 0.0, "<s>"
        for w in tok(text):
            p = max(left[w] - d1[min(left[w], 3)], 0) / types + spare / (len(vocab) + 1)
            if total[before]:
                n = pairs[before, w]
                p = max(n - d2[min(n, 3)], 0) / total[before] + rest[before] / total[before] * p
            out += math.log10(p)
            before = w
        return out

    return score


def test_lm_equals_definition(spark, data):
    docs = {r.doc_id: r.text for r in queries.documents(spark, data).collect()}
    out = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in docs}
    train = [t for i, t in docs.items() if not out[i]]
    tok = lambda t: [*brute.WORD.findall(brute.lower(t or "")), None]
    c = Counter(w for t in train for w in tok(t))
    n, v = sum(c.values()), len(c)
    rows = queries.op1_lm_scoring(spark, data).collect()
    assert len(rows) == len(docs)
    for r in rows:
        words = tok(docs[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[r.doc_id], len(words), sum(c[w] > 0 for w in words), n)
        assert abs(r.base_score - sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)) < 1e-6 * len(words)
    defined = kneser_ney(train)
    for r in rows:
        assert abs(r.score - defined(docs[r.doc_id])) < 1e-6 * r.n_tokens
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_edges(spark):
    frame = lambda *t: spark.createDataFrame([(i, x) for i, x in enumerate(t)], "doc_id long, text string")
    train = frame("a b a b", None, "", "c " * 700, "c " * 400)
    m = lm.fit(train, Scratch(spark, "t"))
    rows = lm.score(frame("", None, "a b", "zzz", "x" * 100_000), m).collect()
    assert rows[0].score == rows[1].score < 0 and all(math.isfinite(r.score) for r in rows) and rows[3].n_known == 1
    # what may follow a context sums to one
    ends = [w for w in ("a", "b", "c", None)]
    t = next(_words.texts(__import__("pyarrow").array(["a b c"])))
    scorer = lm.Scorer(m)
    h = np.append(t.words()[0], lm.END)
    d, u = np.array(m.pair_discounts), np.array(m.word_discounts)
    order = np.argsort(h)
    left = np.empty(len(h), dtype=np.int64)
    left[order] = scorer.word(h[order])[1]
    word = np.maximum(left - u[np.minimum(left, 3)], 0) / m.pairs + m.word_rest / (m.words + 1)
    for before in (h[0], h[2], lm.BEGIN):
        n, stats = scorer.pair(np.full(len(ends), before), h)
        p = np.maximum(n - d[np.minimum(n, 3)], 0) / stats[:, 0] + (stats[:, 1:] @ d[1:]) / stats[:, 0] * word
        unknown = (stats[0, 1:] @ d[1:]) / stats[0, 0] * m.word_rest / (m.words + 1)
        assert abs(p.sum() + unknown - 1) < 1e-9
    empty = lm.fit(train.limit(0), Scratch(spark, "t"))
    assert lm.score(frame("a", None), empty).count() == 2 and lm.score(train.limit(0), m).count() == 0


def test_hot_words_are_spread(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("hot w"), "id", F.lit(" hot v"), "id").alias("text"))
    m = lm.fit(docs, Scratch(spark, "t"))
    assert len(m.frequent) >= 2 and m.stats[:, 0].max() >= 6000
    p = lm.score(docs.limit(20), m).collect()
    assert all(r.score > r.base_score for r in p)
