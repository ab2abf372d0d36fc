from __future__ import annotations

from collections import Counter

import brute
import corpus_pipeline
import numpy as np

from quillrank.llm import queries


def test_pipeline_equals_brute_force(spark, data, tmp_path):
    docs, kept = queries.documents(spark, data), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, data).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(docs.collect())
    start = {r.doc_id: r for r in queries.documents(spark, data).collect()}
    quality, near, secret, mixed, bpe = kept
    verdict = {r.doc_id for r in queries.op7_quality_rules(spark, data).collect() if r.kept}
    assert {r.doc_id for r in quality} == verdict and all(r == start[r.doc_id] for r in quality)
    groups = brute.near_dups([(r.doc_id, r.text) for r in quality], 5, 80)
    assert sorted(r.doc_id for r in near) == sorted(i for i, (_, c) in groups.items() if i == c)
    for r in secret:
        was = start[r.doc_id].text
        spans = brute.secret_spans(was)
        assert (r.text == was) == (not spans) and not brute.secret_spans(r.text) and r.n_chars == len(r.text)
    assert len(secret) == len(near) and [len(r) for r in kept[3][:1]] == [5]
    times = Counter(r.doc_id for r in mixed)
    assert set(times) <= {r.doc_id for r in secret} and max(times.values()) <= 2
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    text = {r.doc_id: r.text for r in secret}
    assert Counter(r.doc_id for r in bpe) == times
    for r in bpe:
        ids = tok.encode(text[r.doc_id], add_special_tokens=False).ids
        assert r.ids == np.array(ids, dtype="<u4").tobytes() and r.decoded_sha256 == brute.sha(tok.decode(ids, skip_special_tokens=False))


def test_stages_keep_rows_with_null_and_repeated_ids(spark, data):
    words = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(40)]
    rows = [(None if i % 2 else 7, w, "en", "s", len(w)) for i, w in enumerate(words)] + [(None, words[0], "en", "s", 0), (7, words[2], "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    near = corpus_pipeline.near_dedup(spark, docs, data)
    assert Counter(r.text for r in near.collect()) == Counter(words)
    times = Counter((r.doc_id, r.text) for r in corpus_pipeline.mix_sources(spark, docs, data).collect())
    there = Counter((i, t) for i, t, *_ in rows)
    assert sum(times.values()) == 63 and all(n <= 2 * there[k] for k, n in times.items())
