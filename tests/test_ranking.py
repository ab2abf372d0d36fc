"""The TF-IDF index against its definition, keyword rankings, and nearest vectors in blocks."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillrank import config
from quillrank.functions import text as X
from quillrank.operators import ranking as R
from quillrank.operators import sections as S
from quillrank.operators import taxonomy

JD = "We need a backend engineer.\n- Python, FastAPI, SQL\n- AWS and Docker"
MATCH = "Skills: Python, FastAPI, SQL, Docker, AWS\nExperience: backend engineer who builds APIs"
PARTIAL = "Skills: Python, React\nExperience: frontend work"
TEXTS = {1: MATCH, 2: PARTIAL, 3: None, 4: "", 5: "nothing of the kind here", 6: MATCH, 7: "the of and", 8: "x " * 50_000 + "python python"}


def grams(text, n):
    words = [w for w in re.sub(r"[\W]+", " ", (text or "").lower()).split() if len(w) > 1 and w not in config.STOP_WORDS]
    return [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def cosines(texts, query, n, sublinear, min_df=1):
    """TF-IDF cosines straight from their definition."""
    counts = {i: Counter(grams(t, n)) for i, t in texts.items()}
    docs = [c for c in counts.values() if c]
    df = Counter(t for c in docs for t in c)
    least = min_df if len(docs) >= 3 and max(df.values()) >= min_df else 1
    idf = {t: math.log((1 + len(docs)) / (1 + k)) + 1 for t, k in df.items() if k >= least}
    weigh = lambda c: {t: (1 + math.log(k) if sublinear else k) * idf[t] for t, k in c.items() if t in idf}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    q, out = weigh(Counter(grams(query, n))), {}
    for i, c in counts.items():
        v = weigh(c)
        if dot := sum(x * q.get(t, 0) for t, x in v.items()):
            out[i] = dot / norm(v) / norm(q)
    return out


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)


def asked(spark, n, **texts):
    rows = spark.createDataFrame(list(texts.items()), "item string, text string")
    return rows.select("item", X.terms(F.col("text"), n, config.STOP_WORDS).alias("terms"), X.extract_skills(F.col("text"), config.SKILLS).alias("skills"))


@pytest.mark.parametrize(("n", "sublinear", "min_df"), [(2, False, 1), (3, True, 1), (3, True, 2)])
def test_cosines_are_those_of_the_definition(spark, n, sublinear, min_df):
    index = S.TermIndex(frame(spark, TEXTS), "doc_id", S.whole(X.terms(F.col("text"), n, config.STOP_WORDS)), sublinear, min_df)
    got: dict = {"jd": {}, "other": {}, "none": {}}
    for r in index.cosines(asked(spark, n, jd=JD, other="python python python experience", none="")).collect():
        got[r.item][r.doc_id] = r.cos
    for item, text in (("jd", JD), ("other", "python python python experience"), ("none", "")):
        want = cosines(TEXTS, text, n, sublinear, min_df)
        assert got[item].keys() == want.keys() and all(abs(got[item][i] - x) < 1e-9 for i, x in want.items())
    index.drop()


def test_sections_have_vocabularies_of_their_own(spark):
    rows = spark.createDataFrame([(1, "python sql", "team"), (2, "java", "team lead"), (3, None, "lead")], "id long, a string, b string")
    parts = F.array(*(F.struct(F.lit(k).alias("section"), X.terms(F.col(c)).alias("terms")) for k, c in (("skills", "a"), ("experience", "b"))))
    near = {r.id: r.similarity for r in S.TermIndex(rows, "id", parts).similarities(asked(spark, 1, jd="python lead"), {"skills": 0.3, "experience": 0.5, "projects": 0.2}).collect()}
    skills, experience = cosines({1: "python sql", 2: "java"}, "python lead", 1, True), cosines({1: "team", 2: "team lead", 3: "lead"}, "python lead", 1, True)
    want = {i: (0.3 * skills.get(i, 0) + 0.5 * experience.get(i, 0)) / 0.8 for i in (1, 2, 3)}
    assert near.keys() == want.keys() and all(abs(near[i] - x) < 1e-9 for i, x in want.items())


def test_an_index_without_terms(spark):
    index = S.TermIndex(frame(spark, {1: None, 2: "", 3: "the of"}), "doc_id", S.whole(X.terms(F.col("text"), 2, config.STOP_WORDS)))
    assert index.cosines(asked(spark, 2, jd=JD)).count() == 0 and index.words().count() == 0
    with pytest.raises(ValueError, match="stop words"):
        index.checked()


def test_keyword_ranking(spark):
    docs, jd = frame(spark, TEXTS), asked(spark, 3, jd=JD, none="words only")
    index = S.TermIndex(docs, "doc_id", S.whole(X.terms(F.col("text"), 3, config.STOP_WORDS)))
    own = docs.select("doc_id", X.extract_skills(F.coalesce("text", F.lit("")), config.SKILLS).alias("skills"))
    rows = S.keyword_scores(index.similarities(jd, {"all": 1.0}), own, jd, "doc_id", 5).collect()
    best = sorted((r for r in rows if r.item == "jd"), key=lambda r: r.rank)
    by = {r.doc_id: r for r in best}
    assert [r.doc_id for r in best][:2] == [1, 6] and {2, 8} < by.keys() and [r.rank for r in best] == [1, 2, 3, 4, 5]
    assert best[0].matched == ["aws", "docker", "fastapi", "python", "sql"] and best[0].missing == [] and best[0].skill == 1.0
    assert by[2].matched == ["python"] and by[2].missing == ["aws", "docker", "fastapi", "sql"] and by[2].skill == 0.2
    want = cosines(TEXTS, JD, 3, True)
    assert all(abs(r.final - min(1, 0.7 * want.get(r.doc_id, 0) + 0.3 * r.skill)) < 1e-9 for r in best)
    # nothing in common: the least keys fill the ranks with 0
    assert [(r.doc_id, r.final) for r in sorted((r for r in rows if r.item == "none"), key=lambda r: r.rank)] == [(i, 0.0) for i in range(1, 6)]


def test_nearest_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6)).astype(np.float32)
    x[7] = x[8]
    rows = [(i, [float(v) for v in x[i]]) for i in range(300)] + [(300, None), (301, [0.0] * 6), (302, [None] * 6)]
    vectors = spark.createDataFrame(rows, "id long, vec array<float>")
    queries = vectors.where("id % 20 = 7 OR id >= 300").select(F.col("id").alias("q"), F.col("vec").alias("q_vec"))
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    want = set()
    for q in range(7, 300, 20):
        d2 = np.round(np.maximum(2 - 2 * u @ u[q], 0), 6)
        want |= {(q, int(i), float(d2[i])) for i in np.lexsort((np.arange(300), d2))[:12]}
    for block in (8_192, 50):
        got = R.nearest_l2(vectors, queries, 12, block).collect()
        assert {(r.q, r.id, r.d2) for r in got} == want and all(abs(r.similarity - 1 / (1 + r.d2)) < 1e-4 for r in got)
    assert R.nearest_l2(vectors.limit(0), queries, 3).count() == 0
    monkeypatch.setattr(taxonomy, "BLOCK", 40)
    at = vectors.where("id < 300").withColumnRenamed("id", "at")
    best = {r.at: r.canon for r in taxonomy.nearest(at, at.where("at < 100"), ordered=False).collect()}
    assert best == {i: int(np.round(u[:100] @ u[i], 9).argmax()) for i in range(300)}


def test_semantic_scores(spark):
    rng = np.random.default_rng(4)
    x, w = rng.normal(size=(60, 5)), rng.normal(size=(4, 5))
    chunks = spark.createDataFrame([(i % 3, i, [float(v) for v in x[i]]) for i in range(60)] + [(9, 99, [0.0] * 5)], "candidate long, chunk_idx long, vec array<double>")
    wanted = spark.createDataFrame([(i, [float(v) for v in w[i]]) for i in range(4)], "w_id long, w_vec array<double>")
    u = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    cos = (u(x) @ u(w).T).max(axis=1)
    got = {r.candidate: (r.semantic, r.top) for r in R.semantic(wanted, chunks).collect()}
    for c in range(3):
        own = [i for i in np.argsort(-cos) if i % 3 == c][:3]
        assert abs(got[c][0] - cos[own].mean()) < 1e-12 and got[c][1] == own
    assert got.keys() == {0, 1, 2}
