"""Growing taxonomies against the loop one by one, tables that change together, queues and keys that survive a kill."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillrank.operators import taxonomy
from quillrank.operators.taxonomy import Taxonomy
from quillrank.sources.versions import Versions
from quillrank.streaming.queue import Queue, Seen

SKILLS = "at long, name string, vec array<float>"


def one_by_one(rows, least):
    """The loop: each name maps to the nearest canonical one over `least`, or becomes one."""
    names, units, out = [], np.empty((0, 8)), []
    for _, name, vec in sorted(rows):
        name = name.lower().strip()
        if not name:
            continue
        x = np.array(vec if vec else [0.0] * 8, dtype=np.float32).astype(np.float64)
        x = x / (np.linalg.norm(x) or 1)
        cos = np.round(units @ x, 9) if names else np.empty(0)
        if len(cos) and cos.max() > least:
            out.append(names[int(cos.argmax())])
            continue
        if name not in names:
            names.append(name)
            units = np.vstack([units, x])
        out.append(name)
    return out, names


def skills(n):
    rng = np.random.default_rng(n)
    base = rng.normal(size=(n // 20, 8))
    rows = [(i, f" Skill {i} ", [float(x) for x in base[rng.integers(len(base))] + 0.25 * rng.normal(size=8)]) for i in range(n)]
    rows[3], rows[40], rows[n // 2] = (3, "zero", [0.0] * 8), (40, "Zero", None), (n // 2, "  ", rows[0][2])
    return rows


@pytest.mark.parametrize(("n", "batches", "block"), [(400, 1, 32), (400, 7, 64), (10_000, 3, 2_048)])
def test_taxonomy_is_that_of_the_loop(spark, monkeypatch, n, batches, block):
    monkeypatch.setattr(taxonomy, "BLOCK", block)
    rows = skills(n)
    want, names = one_by_one(rows, 0.85)
    frame = spark.createDataFrame(rows, SKILLS).cache()
    grown = Taxonomy(frame, 0.85)
    for k in range(batches):
        grown.add(frame.where(F.floor(F.col("at") * batches / n) == k), k)
        if k == 1:
            grown.add(frame.where(F.floor(F.col("at") * batches / n) == k), k)
    assert [r.canonical for r in grown.mapped().orderBy("at").collect()] == want
    assert [r.name for r in grown.entries().orderBy("at").collect()] == names and 10 < len(names) < n / 2


def test_taxonomy_of_a_stream_and_of_nothing(spark, tmp_path):
    rows = skills(200)
    frame = spark.createDataFrame(rows, SKILLS)
    for k in range(2):
        frame.where(F.floor(F.col("at") / 100) == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    grown = Taxonomy(frame, 0.85)
    grown.stream(spark.readStream.schema(SKILLS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), f"{tmp_path}/checkpoint")
    assert [r.canonical for r in grown.mapped().orderBy("at").collect()] == one_by_one(rows, 0.85)[0]
    assert Taxonomy(frame).add(frame.limit(0), 0).count() == 0


def test_readers_see_old_or_new_and_others_stay(spark, tmp_path):
    store = Versions(spark, str(tmp_path))
    of = lambda rows: {"rankings": spark.createDataFrame(rows, "job long, score int"), "settings": spark.createDataFrame([(j, s) for j, s in rows], "job long, weight int")}
    with pytest.raises(ValueError, match="nothing"):
        store.read("rankings")
    store.commit(of([(1, 10), (2, 20)]))
    before = store.read("rankings")
    draft = store.prepare(of([(1, 11)]))
    read = lambda: [sorted(map(tuple, store.read(n).select("job", c).collect())) for n, c in (("rankings", "score"), ("settings", "weight"))]
    assert read() == [[(1, 10), (2, 20)]] * 2
    store.publish(draft)
    assert read() == [[(1, 11), (2, 20)]] * 2 and sorted(r.score for r in before.collect()) == [10, 20]
    store.prepare(of([(2, 99)]))
    assert len(store.vacuum()) == 1 and read() == [[(1, 11), (2, 20)]] * 2
    store.commit({"rankings": spark.createDataFrame([], "job long, score int"), "settings": spark.createDataFrame([], "job long, weight int")}, owners=spark.createDataFrame([(2,)], "job long"))
    assert read() == [[(1, 11)]] * 2


def test_queue_moves_each_row_once(spark, tmp_path):
    queue, ids = Queue(spark, str(tmp_path)), lambda *xs: spark.createDataFrame([(x,) for x in xs], "id long")
    tried: list = []

    def work(claimed):
        tried.append(sorted(r.id for r in claimed.collect()))
        if len(tried) == 1:
            raise RuntimeError("killed")
        return claimed.where("id != 3").select("id", F.when(F.col("id") == 2, "failed").when(F.col("id") == 4, "odd").otherwise("processed").alias("state"), F.lit("r").alias("reason"))

    queue.submit(ids(1, 2, 2), 0)
    with pytest.raises(RuntimeError):
        queue.run(0, work)
    assert {r.id: r.state for r in queue.states().collect()} == {1: "processing", 2: "processing"}
    queue.submit(ids(1, 2, 2), 0)
    queue.run(0, work)
    queue.run(0, work)
    queue.submit(ids(2, 3, 4), 1)
    queue.run(1, work)
    assert tried == [[1, 2], [1, 2], [3, 4]]
    got = {r.id: (r.state, r.reason, r.changes) for r in queue.states().collect()}
    assert got == {1: ("processed", "r", 3), 2: ("failed", "r", 3), 3: ("failed", "no result", 3), 4: ("failed", "no result", 3)}


def test_seen_keys(spark, tmp_path):
    seen = Seen(spark, str(tmp_path), buckets=4, merge=2)
    batches = [[(1, "a"), (2, "a"), (3, None)], [(4, "b"), (5, "a")], [(6, "b"), (7, "c"), (8, None)], [(9, "c"), (10, "d")]]
    got = []
    for k, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, "id long, text string")
        first = sorted(r.id for r in seen.first(frame, k).collect())
        assert sorted(r.id for r in seen.first(frame, k).collect()) == first
        got.append(first)
    assert got == [[1, 3], [4], [7, 8], [10]] and len(seen.keys.names()) <= 3
