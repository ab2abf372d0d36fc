"""Columns of the caller's that are called like an operator's own, nulls, ties, repeated rows and empty tables."""

from __future__ import annotations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from quillrank.llm import bpe, chat, counts, exact, lexical, lm, mixing, neardup, periodic, quality, queries, secrets, sharding, vectors
from quillrank.llm._scratch import Scratch

NAMES = ["ids", "found", "_found", "_kinds", "kinds", "_row", "row", "_times", "_n", "shard", "slot", "_j", "jump", "grown_shard", "id", "key", "k1", "name", "_name", "gone",
         "decoded", "size", "draws", "_h", "target", "bucket", "before", "n", "score", "band", "root", "n_words", "kept", "lang.x", "_m", "component_id", "uid", "probes"]
WORDS = " ".join(f"w{i}" for i in range(60))
ROWS = [(1, WORDS, "en", "a", 9), (1, WORDS, "en", "a", 9), (None, WORDS + " token=abcdefghij", None, None, None), (2, None, "en", "a", None), (3, "", None, "b", 0), (3, "x " * 90_000, "en", "b", 1), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(ROWS, queries.DOCUMENTS)
    return plain.select("*", *(F.lit(f"own {n}").alias(n) for n in NAMES))


def own(rows, gone=()):
    """Every column of the caller's that doesn't give way has its value still."""
    for r in rows:
        x = r.asDict()
        assert all(x[n] == f"own {n}" for n in NAMES if n not in gone)
    return rows


def test_operators_keep_other_columns(spark, docs):
    assert len(own(secrets.scan(docs).collect(), {"found"})) == 7
    assert len(own(secrets.redact(secrets.scan(docs)).collect(), {"found"})) == 7
    path = queries.tokenizer_path()
    assert len(own(bpe.encode(docs, path, piece=1000).collect(), {"ids"})) == 7
    assert len(own(bpe.encode(docs, path, back=True).collect(), {"ids", "decoded"})) == 7
    given = {"shard", "slot", "grown_shard"}
    rows = own(sharding.assign_shards(docs, "doc_id", 4, ["text", "size"]).collect(), given)
    assert len(rows) == 7 and all(isinstance(r["slot"], int) for r in rows)
    assert len({r["shard"] for r in rows if r["doc_id"] is None}) == 1
    assert all(r.f.n_words >= 0 for r in own(docs.withColumn("f", periodic.periodic_runs(F.col("text"))).collect()))
    out = mixing.materialise(docs, [3, 1], shards=2)
    assert all(r["shard"] in (0, 1) for r in own(out.collect(), {"shard"}))
    assert len(own(neardup.one_of_each(docs, neardup.Near(5, 80, 5, 40)).collect())) == 5
    scratch = Scratch(spark, "clash")
    assert len(own(quality.filter_docs(docs, scratch.save).collect())) == 3


def test_operators_leave_other_columns_out(spark, docs):
    assert neardup.near_duplicates(docs).count() == 7
    assert mixing.mix(docs, [1]).count() == 7
    m = lm.fit(docs, Scratch(spark, "clash"))
    assert lm.score(docs, m).count() == 7
    assert exact.exact_duplicates(docs).count() == 7 and exact.exact_duplicates(docs).where("kept").count() == 4
    scratch = Scratch(spark, "clash")
    items = docs.where("n_chars = 9").limit(1).withColumn("item_id", F.lit(5)).withColumns({"query": F.lit("x"), "term": F.lit("y"), "block": F.lit(0), "weight": F.lit(0)})
    ranks = lexical.search(lexical.build(docs, scratch), items, scratch).collect()
    assert ranks[0].asDict().keys() == {"item_id", "rank", "doc_id", "score"} and sorted(r.rank for r in ranks) == [1, 2, 3]
    turns = docs.withColumns({"conv_id": F.lit(1), "turn": F.lit(1), "role": F.lit("assistant"), "formatted": F.lit(0), "is_last": F.lit(0), "_turns": F.lit(0)})
    assert chat.digest(chat.expand(turns)).first()["n_turns"] == 7
    rows = docs.withColumns({"vec_id": F.col("doc_id"), "embedding": F.array(F.lit(1.0), F.lit(2.0)), "label": F.lit(1), "cell": F.lit(0), "least_id": F.lit(0)})
    assert vectors.near_duplicates(rows).count() == 7
    changes = docs.select("source", "lang", F.lit("1").alias("tokenizer_version"), F.lit("insert").alias("op"), F.lit(1).alias("n_tokens"), F.lit(0).alias("old_n_tokens"), *(f"`{n}`" for n in NAMES))
    assert counts.summed(counts.signed(changes)).agg(F.sum("n_docs")).first()[0] == 7


def test_stages_take_any_columns_and_empty_tables(spark, docs, data, tmp_path):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars", *(f"`{n}`" for n in NAMES if n != "found"))
    gone = {"found", "ids"}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, plain.limit(0), data).count() == 0
        out = stage(spark, plain, data)
        if name != "bpe":
            assert out.columns == plain.columns
            own(out.collect(), gone - {"ids"})
        else:
            assert out.count() == 7


def test_repeated_rows_are_mixed_each(spark, docs):
    same = spark.createDataFrame([(1, "a b c d", "en", "s", 7), (1, "a b c d", "en", "s", 7), (1, "e f g h", "en", "s", 7)], queries.DOCUMENTS)
    # 150 % of 12 words: 18 words; every document at most twice
    out = [r.text for r in mixing.materialise(same, [1], shards=2).collect()]
    drawn = mixing.mix(same, [1], shards=2).select(F.sum(F.size("draws"))).first()[0]
    assert len(out) == drawn in (4, 5) and out.count("a b c d") <= 4 and out.count("e f g h") <= 2


def test_shards_are_shuffled_and_reruns_agree(spark):
    plain = spark.createDataFrame([(i, f"w{i} " * 5, "en", "s", i) for i in range(300)], queries.DOCUMENTS)
    first = [(r.shard, r.doc_id) for r in mixing.materialise(plain, [1], shards=4).collect()]
    again = [(r.shard, r.doc_id) for r in mixing.materialise(plain.repartition(7), [1], shards=4).collect()]
    by = lambda rows: {s: [i for k, i in rows if k == s] for s in range(4)}
    assert by(first) == by(again) and len(first) == 450
    for ids in by(first).values():
        assert 110 <= len(ids) <= 115 and ids != sorted(ids)
