"""Readers in order, engines with time limits, archives by member, models in their slots, times of streams."""

from __future__ import annotations

import io
import re
import sys
import time
import zipfile

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quillrank.operators import latency, models
from quillrank.operators import indexing as I
from quillrank.sources import files, readers
from quillrank.streaming import progress

# workers have the package, not the tests
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS = "The Quick brown Fox met NovaPay in Berlin and quick Berlin met the fox "


def reader(content):
    text = content.decode()
    if text.startswith("bad"):
        raise ValueError("no header")
    return text, 2


def missing():
    raise ImportError("x")


def test_cascade(spark):
    rows = spark.createDataFrame([("a.pdf", bytearray(b"good")), ("b.pdf", bytearray(b"bad one")), ("c.pdf", bytearray(b"bad\xff"))], files.FILE)
    got = {r.name: r[1:] for r in readers.cascade(rows, [("absent", missing), ("first", lambda: reader), ("second", lambda: lambda c: (c.decode("ascii")[4:], 1))]).collect()}
    assert got["a.pdf"] == ("good", 2, "first", None) and got["b.pdf"] == ("one", 1, "second", None)
    text, pages, backend, error = got["c.pdf"]
    assert (text, pages, backend) == (None, 1, "none") and error.startswith("absent not installed; first: ") and "second: " in error


def primary(content):
    kind = content.decode().split()[0]
    if kind == "slow":
        time.sleep(5)
    if kind == "raises":
        raise ValueError("blurred")
    return {"blank": "  ", "part": "", "good": " read "}.get(kind, "")


def test_states(spark):
    kinds = {"long": "x" * 150, "good": "good", "slow": "slow", "raises": "raises", "blank": "blank", "nothing": "both nothing"}
    rows = spark.createDataFrame([(k, bytearray(v.encode())) for k, v in kinds.items()], files.FILE)
    own = [("own", lambda: lambda c: (c.decode(), 1))]
    tries: list = []
    second = lambda c: "second try" if c in (b"slow", b"raises") else " " if c == b"blank" else tries[9]
    got = {r.name: r for r in readers.extracted(rows, own, lambda: primary, lambda: second, retries=2, seconds=0.5).collect()}
    state = {k: (r.method, r.state, r.ocr_triggered, r.text, r.failure_reason) for k, r in got.items()}
    assert state["long"] == ("direct", "TEXT_EXTRACTED", False, "x" * 150, None) and state["good"] == ("ocr_primary", "OCR_DONE", True, "read", None)
    assert state["slow"] == state["raises"] == ("ocr_fallback", "OCR_DONE", True, "second try", None)
    assert state["blank"] == ("ocr_primary", "OCR_FAILED", True, "blank", "primary: primary OCR returned no text")
    assert state["nothing"] == ("ocr_fallback", "OCR_FAILED", True, "both nothing", "primary: primary OCR returned no text; fallback: list index out of range")
    off = {r.name: (r.state, r.failure_reason) for r in readers.extracted(rows, own).collect()}
    assert off["good"] == ("OCR_FAILED", "OCR disabled; direct text insufficient") and off["long"] == ("TEXT_EXTRACTED", None)


def test_archives_by_member(spark, tmp_path):
    def archive(name, members):
        with zipfile.ZipFile(tmp_path / name, "w", zipfile.ZIP_DEFLATED) as z:
            for k, v in members.items():
                z.writestr(k, v)

    archive("large.zip", {f"d/{i}.txt": f"text {i} " * 20 for i in range(10_000)} | {"d/": "", "__MACOSX/._x": ""})
    archive("small.zip", {"a.txt": "a", "b.txt": "b"})
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    broken = bytearray((tmp_path / "small.zip").read_bytes())
    broken[30 + len("a.txt")] ^= 0xFF
    (tmp_path / "half.zip").write_bytes(broken)
    listed = readers.directory(spark, str(tmp_path))
    got = readers.members(listed, 8)
    assert got.withColumn("part", F.spark_partition_id()).where("archive LIKE '%large%'").groupBy("part").count().where("count > 800").count() == 8
    rows = {(r.archive.rsplit("/", 1)[1], r.name): (bytes(r.content) if r.content is not None else None, r.error) for r in got.collect()}
    assert rows["large.zip", "d_77.txt"] == (b"text 77 " * 20, None) and len(rows) == 10_000 + 2 + 2 + 1
    assert rows["bad.zip", None][0] is None and rows["bad.zip", None][1]
    assert rows["half.zip", "a.txt"][0] is None and rows["half.zip", "a.txt"][1] and rows["half.zip", "b.txt"] == (b"b", None)


def test_descriptions(spark):
    up = spark.createDataFrame([("j", "My JD.PDF", bytearray(b"1")), ("j", "x.txt", bytearray(b"2")), ("k", "x.exe", bytearray(b"3"))], "owner string, name string, content binary")
    got = {(r.owner, r.path): r.error for r in readers.description_files(up).collect()}
    assert got == {("j", "jd.pdf"): None, ("j", "jd.txt"): None, ("k", None): "Unsupported JD file type. Allowed: .pdf, .docx, .txt"}


def test_encoder_takes_batches_and_gives_unit_vectors(spark):
    def factory():
        def model(texts):
            assert len(texts) <= 32
            return np.array([[len(texts), len(t)] if t != "zero" else [0, 0] for t in texts], dtype=float)

        return model

    rows = spark.range(100).select(F.when(F.col("id") % 10 == 0, None).when(F.col("id") % 10 == 1, "").when(F.col("id") == 2, "zero").otherwise(F.repeat(F.lit("x"), F.col("id").cast("int"))).alias("t"), "id")
    got = {r.id: r.v for r in rows.coalesce(1).select("id", models.encoded(F.col("t"), factory).alias("v")).collect()}
    assert all(got[i] is None for i in range(100) if i % 10 < 2 or i == 2) and all(abs(np.linalg.norm(v) - 1) < 1e-6 for v in got.values() if v)
    assert got[3][0] > 0.9 and rows.limit(0).select(models.encoded(F.col("t"), factory)).count() == 0


def test_windows_give_what_one_pass_gives(spark):
    def factory():
        def tag(text):
            if "poison" in text:
                raise ValueError("no")
            return [(m[0], "N") for m in re.finditer(r"[A-Za-z]+", text) if m[0][0].isupper() or m[0] in ("quick", "fox")] + [(" ", "N")]

        return tag

    texts = [WORDS * 200, "", None, "  \n", "one " * 30 + "Last", "poison " + "a " * 400 + "End"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: [tuple(e) for e in r.entities] for r in models.entities(rows, "id", "text", factory, 50, 10).collect()}
    assert [w for w, _ in got[0]] == ["The", "Quick", "Fox", "NovaPay", "Berlin"]
    assert got[1] == got[2] == got[3] == [] and got[4] == [("Last", "N")] and got[5] == [("End", "N")]


def test_times_of_a_stream_are_latency_samples(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/in")
    with progress.StageTimes(spark) as times:
        rows = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        rows.writeStream.queryName("q").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    log = times.take().cache()
    assert {r.query for r in log.collect()} == {"q"} and {"addBatch", "triggerExecution"} <= {r.stage for r in log.collect()} and times.take().count() == 0
    report = {r.stage: r for r in latency.statistics(log.groupBy("stage", "ms").agg(F.count("*").alias("n"))).collect()}
    assert report["addBatch"]["count"] >= 1 and report["addBatch"].max_ms <= report["triggerExecution"].max_ms


RESUME = """ALICE CHEN

SUMMARY
Backend software engineer.

WORK EXPERIENCE
Senior Software Engineer, NovaPay
Jan 2021 - Dec 2023

EDUCATION
Master of Science, Computer Science, 2016

SKILLS
Python, FastAPI, Docker
"""


def docx(*paragraphs):
    w, out = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>' + "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs) + "</w:body></w:document>")
    return out.getvalue()


def test_files_from_an_archive_to_side_tables(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "cv.zip", "w") as z:
        for name, content in {"a/alice.txt": RESUME, "a/copy.txt": RESUME, "b.docx": docx("Bob", "python sql"), "c.docx": b"broken", "d.txt": " \n\t", "e.pdf": b"%PDF"}.items():
            z.writestr(name, content)
    got = readers.members(readers.directory(spark, str(tmp_path)), 2)
    checked = {r.name: (r.status, r.reason) for r in I.write_processed(got.select("name", "content"), f"{tmp_path}/out").collect()}
    assert checked["a_alice.txt"] == ("OK", None) and checked["a_copy.txt"] == ("DUPLICATE", "Duplicate of a_alice.txt") and checked["b.docx"] == ("OK", None)
    assert checked["c.docx"][0] == "FAILED" and checked["d.txt"] == ("EMPTY", "Validation failed") and checked["e.pdf"][0] == "FAILED"
    read = lambda n: {r.name: r for r in spark.read.parquet(f"{tmp_path}/out/{n}").collect()}
    sections, entities, experience = read("sections"), read("entities"), read("experience")
    assert set(sections) == {"a_alice.txt", "b.docx"} and sections["a_alice.txt"].skills == "Python, FastAPI, Docker" and sections["a_alice.txt"].summary == "Backend software engineer."
    assert set(entities["a_alice.txt"].skills) == {"python", "fastapi", "docker"} and set(entities["b.docx"].skills) == {"python", "sql"} and entities["a_alice.txt"].field
    assert (experience["a_alice.txt"].earliest, experience["a_alice.txt"].latest) == (2016, 2023)
    assert {n: r.duplicate_of for n, r in read("duplicates").items()} == {"a_copy.txt": "a_alice.txt"}
