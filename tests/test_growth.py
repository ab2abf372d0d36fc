"""Tables as they are where they grow: folders of files, other keys, bounded tasks."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillrank.functions import text as X
from quillrank.operators import grams as G
from quillrank.operators import sections as S
from quillrank.plans import registry, textual
from quillrank.plans.base import spread
from quillrank.sources import readers


def documents(spark, folder, rows, files=2):
    spark.createDataFrame(rows, "doc_id long, text string").repartition(files).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_ingest_of_a_folder_of_files(spark, tmp_path):
    for name, texts in (("some", ["a", "b", "a", None]), ("none", [])):
        got = registry.QUERIES["incremental_ingest"](spark, documents(spark, tmp_path / name, list(enumerate(texts))))
        assert sorted(r.h for r in got.collect()) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in {*texts} - {None})


def test_numbers_of_files_are_no_years(spark, tmp_path):
    got = registry.QUERIES["process_files"](spark, documents(spark, tmp_path, [(k, "") for k in (1901, 1924, 2006, 2099)]))
    assert {r.name: (r.earliest, r.latest) for r in got.collect()} == {f"cv{k:09d}.txt": (1990 + k % 20, 1993 + k % 20 + k % 5) for k in (1901, 1924, 2006, 2099)}


def test_terms_are_dealt_by_the_size_of_texts(spark, monkeypatch):
    monkeypatch.setattr(S, "TEXT", 200)
    monkeypatch.setattr(S, "LEAST_BUCKETS", 2)
    texts = {k: " ".join(f"w{k * j % 41}" for j in range(1, 40)) + (" python" if k % 3 == 0 else "") for k in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    index = S.TermIndex(docs, "doc_id", S.whole(X.terms(F.col("text"), 2)), min_df=2)
    assert index.parts > 30 and index.postings.where("bucket >= 0").select("chunk").distinct().count() > 4
    want: dict = {}
    for k, t in texts.items():
        w = t.split()
        for gram, n in Counter(w + [" ".join(p) for p in zip(w, w[1:], strict=False)]).items():
            want[gram, k] = n
    hashed = spark.createDataFrame([(g, k, n) for (g, k), n in want.items()], "word string, doc_id long, n long").select(F.xxhash64(F.lit("all"), "word").alias("term"), "doc_id", "n")
    got = index.counts.select("term", "doc_id", "n")
    assert got.exceptAll(hashed).count() == hashed.exceptAll(got).count() == 0
    df = Counter(g for g, _ in want)
    length = Counter()
    for (g, k), n in want.items():
        if df[g] > 1:
            length[k] += ((1 + math.log(n)) * (math.log(61 / (1 + df[g])) + 1)) ** 2
    assert {r.doc_id: round(r.norm, 9) for r in index.norms.collect()} == {k: round(math.sqrt(x), 9) for k, x in length.items()}
    assert {r.word: r.df for r in index.words().collect()} == dict(df)
    index.drop()


def test_the_best_by_skills_alone(spark):
    docs = spark.createDataFrame([(k, ["a", "b"] if k % 2 else ["b"]) for k in range(40)], "doc_id long, skills array<string>")
    jd = spark.createDataFrame([(0, ["a", "c"]), (1, [])], "item long, skills array<string>")
    found = spark.createDataFrame([(0, 9, 0.3), (0, 2, 0.5)], "item long, doc_id long, similarity double")
    rows = sorted((r.item, r.rank, r.doc_id, r.matched, r.missing) for r in S.keyword_scores(found, docs, jd, "doc_id", 5).collect())
    assert rows[:5] == [(0, i + 1, k, ["a"] if k % 2 else [], ["c"] if k % 2 else ["a", "c"]) for i, k in enumerate([9, 2, 1, 3, 5])]
    assert [r[2] for r in rows[5:]] == [0, 1, 2, 3, 4]


def test_costly_rows_are_spread(spark, tmp_path):
    spark.range(20_000).selectExpr("id AS p_partkey", "'part' AS p_name").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = registry.QUERIES["resume_intelligence"](spark, str(tmp_path))
    assert got.rdd.getNumPartitions() == 4
    assert spread(spark.range(20_000), "id", 1_000).rdd.getNumPartitions() == 20


def test_files_go_to_readers_in_small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, "10000")
    rows = spark.range(1_200).coalesce(1).selectExpr("concat('f', id) AS name", "CAST(CAST(id AS STRING) AS BINARY) AS content")
    assert readers.cascade(rows, [("own", lambda: lambda content: (str(len(content)), 1))]).count() == 1_200
    assert int(spark.conf.get(name)) <= 500
    spark.conf.set(name, "100")
    readers.scanned(rows, lambda: lambda content: "", None)
    assert spark.conf.get(name) == "100"
    spark.conf.unset(name)


def test_grams_are_dealt_by_the_size_of_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textual, "TEXT", 100)
    d = documents(spark, tmp_path, [(k, "red red green") for k in range(80)])
    got = registry.QUERIES["ngrams"](spark, d)
    assert got.rdd.getNumPartitions() == 11
    assert {(r.gram, r.n, r.docs) for r in got.collect()} == {("red", 160, 80), ("green", 80, 80), ("red red", 80, 80), ("red green", 80, 80), ("red red green", 80, 80)}


def test_grams_are_counted_from_words_that_are_sent_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textual, "TEXT", 4_000)
    monkeypatch.setattr(textual, "CHUNK", 2_000)
    monkeypatch.setattr(G, "SAMPLE", 20_000)
    # a document has two rows, one has no number, and two words are in all
    texts = [(k // 2 if k < 60 else k, " ".join(f"w{k * j % 97}" if j % 3 else "often red" for j in range(1, 90 + k))) for k in range(90)]
    rows = [*texts, (None, "often red w1 w2"), (500, None), (501, "the of"), (502, "red red red often often red")]
    d = documents(spark, tmp_path, rows)
    n, docs = Counter(), Counter()
    seen = set()
    for k, t in rows:
        w = [x for x in (t or "").split() if x not in ("the", "of")]
        for gram in w + [" ".join(w[i : i + m]) for m in (2, 3) for i in range(len(w) - m + 1)]:
            n[gram] += 1
            if k is not None and (gram, k) not in seen:
                seen.add((gram, k))
                docs[gram] += 1
    got = registry.QUERIES["ngrams"](spark, d)
    assert {(r.gram, r.n, r.docs) for r in got.collect()} == {(g, c, docs[g]) for g, c in n.items()} and got.count() == len(n)


def test_what_is_sent_of_words_is_less_than_their_grams():
    rng = np.random.default_rng(1)
    names = pa.array([f"word{i}" for i in range(5_000)])
    code = (rng.zipf(1.3, 200_000) - 1) % 5_000
    words = G.Words(names, code, np.full(400, 500), np.arange(1, 401), np.zeros(400, dtype=np.int64), ["all"])
    last = [f"word{i}" for i in range(40, -1, -1)]
    blocks = list(G.Grams(words, 3, 8, last, False).blocks())
    grams = sum(len(names[int(c)].as_py()) for c in code[:2_000]) * 6 * 100
    assert sum(len(b) for _, b in blocks) < grams / 8
    sizes = [len(b) for _, b in blocks]
    assert len(sizes) == 8 and max(sizes) < 1.5 * sum(sizes) / 8
    assert G.Words.restored(words.stored()).code.tolist() == code.tolist()


def stored_bytes(folder):
    return sum(p.stat().st_size for p in Path(folder.removeprefix("file://").removeprefix("file:")).rglob("*.parquet"))


def test_tables_of_an_index_do_not_grow_with_its_buckets(spark, monkeypatch):
    monkeypatch.setattr(S, "TEXT", 100_000)
    rng = np.random.default_rng(2)
    texts = [(k, " ".join(f"w{i}" for i in rng.integers(0, 4_000, 60))) for k in range(2_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    sizes = []
    for buckets in (8, 256):
        monkeypatch.setattr(S, "LEAST_BUCKETS", buckets)
        index = S.TermIndex(docs, "doc_id", S.whole(X.terms(F.col("text"), 1)))
        sizes.append(stored_bytes(index.root))
        index.drop()
    assert sizes[1] < 2 * sizes[0]


def test_grams_of_sections_are_made_from_words(spark, monkeypatch):
    monkeypatch.setattr(S, "TEXT", 3_000)
    monkeypatch.setattr(G, "SAMPLE", 3_000)
    monkeypatch.setattr(S, "WANTED", 5)
    # the first document has two rows, one has no number and one no section; "often" is in all
    rows = [(k if k else 1, f"a{k * 7 % 5} b{k % 3} often often c{k % 11}", f"often x{k % 4} often b{k % 3}" if k % 2 else "") for k in range(120)]
    rows += [(None, "often a1 b1", "often"), (500, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, a string, b string")
    part = lambda name, c: F.struct(F.lit(name).cast("string").alias("section"), X.terms(F.col(c)).alias("terms"))
    index = S.TermIndex(docs, "doc_id", F.array(part("a", "a"), part("b", "b"), part(None, "a")), min_df=2, n=3)
    tf: dict = {}
    for k, *texts in rows:
        for section, text in zip("ab", texts, strict=True):
            w = (text or "").split()
            for gram in w + [" ".join(w[i : i + m]) for m in (2, 3) for i in range(len(w) - m + 1)]:
                tf.setdefault(section, {}).setdefault(gram, Counter())[k] += 1
    docs_of = {s: len({k for ks in grams.values() for k in ks}) for s, grams in tf.items()}
    assert index.sizes == docs_of and index.least == {"a": 2, "b": 2}
    idf = {s: {g: (math.log((1 + docs_of[s]) / (1 + len(ks))) + 1 if len(ks) > 1 else 0) for g, ks in grams.items()} for s, grams in tf.items()}
    square, cos = Counter(), Counter()
    asked = {"often": 1, "often b1": 2, "a1 b1 often": 1, "nowhere": 1, "often nowhere": 1, "b1 often often": 1, "b2": 1}
    for s, grams in tf.items():
        q = {g: (1 + math.log(n)) * idf[s][g] for g, n in asked.items() if idf[s].get(g)}
        for g, ks in grams.items():
            for k, n in ks.items():
                square[k, s] += ((1 + math.log(n)) * idf[s][g]) ** 2
                cos[k, s] += (1 + math.log(n)) * idf[s][g] * q.get(g, 0) / math.sqrt(sum(x * x for x in q.values()))
    assert {(r.doc_id, r.section): round(r.norm, 9) for r in index.norms.collect()} == {k: round(math.sqrt(x), 9) for k, x in square.items() if x}
    wanted = spark.createDataFrame([(7, [g for g, n in asked.items() for _ in range(n)]), (8, [])], "item long, terms array<string>")
    got = {(r.item, r.doc_id, r.section): round(r.cos, 9) for r in index.cosines(wanted).collect()}
    assert got == {(7, *k): round(x / math.sqrt(square[k]), 9) for k, x in cos.items() if x}
    assert {(r.section, r.word): r.df for r in index.words().collect()} == {(s, g): len(ks) for s, grams in tf.items() for g, ks in grams.items()}
