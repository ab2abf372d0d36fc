"""Files, sinks, streams and small golden cases."""

from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quillrank import config
from quillrank.functions import dates as D
from quillrank.functions import entities as E
from quillrank.functions import sections as S
from quillrank.functions import text as X
from quillrank.sources import files, sinks
from quillrank.streaming import ingest


def packed(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in members.items():
            z.writestr(name, content)
    return out.getvalue()


def docx(*paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    return packed({"word/document.xml": f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>'})


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_unzip_and_read(spark):
    archive = packed({"a/b.txt": b" caf\xc3\xa9 \xff", "__MACOSX/._x.txt": b"", ".DS_Store": b"", "c.docx": docx("One", " ", "two"), "d.pdf": b"%PDF"})
    archives = spark.createDataFrame([("z.zip", bytearray(archive)), ("bad.zip", bytearray(b"no"))], files.FILE)
    rows = files.unzip(archives)
    assert {(r["name"], r["error"]) for r in rows.collect()} == {("a_b.txt", None), ("c.docx", None), ("d.pdf", None), (None, "not a ZIP file")}
    got = {r["name"]: (r["text"], r["error"]) for r in files.texts(rows.where("name IS NOT NULL").select("name", "content")).collect()}
    assert got["a_b.txt"] == ("café", None) and got["c.docx"] == ("One two", None) and got["d.pdf"] == (None, "no reader for pdf")
    read = files.texts(rows.where("name = 'd.pdf'").select("name", "content"), {"pdf": lambda b: "page"}).first()
    assert read["text"] == "page"


def test_listing_and_names(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.txt", "in/b.TXT", "in/c.exe", "in/._d.txt"):
        (tmp_path / name).write_text("x")
    assert sorted(r["name"].rsplit("/", 1)[1] for r in files.listing(spark, str(tmp_path)).collect()) == ["a.txt", "b.TXT"]
    df = spark.createDataFrame([("a.txt", 1), ("a.txt", 2), ("b", 3), ("b", 4), ("c.txt", 5)], "name string, at int")
    assert [r["name"] for r in files.unique_names(df, ["at"]).orderBy("at").collect()] == ["a.txt", "a_2.txt", "b", "b_2", "c.txt"]


def test_names_go_past_taken_numbers(spark):
    given = ["a.txt", "a.txt", "a_2.txt", "a.txt", "a_2.txt", "a_4.txt", "b_01", "b", "b", ".txt", ".txt", "a.pdf", "c_2.x", "a.txt", "a_1.txt", "x.txt" * 3]
    df = spark.createDataFrame(list(zip(given, range(len(given)), strict=True)), "name string, at int").withColumn("_x", F.lit(1))
    out = files.unique_names(df, ["at"])
    got = [r["name"] for r in out.orderBy("at").collect()]
    assert out.columns == df.columns and len(set(got)) == len(given)
    assert all(g == n or n in given[:i] for i, (g, n) in enumerate(zip(got, given, strict=True)))
    assert got[:6] == ["a.txt", "a_3.txt", "a_2.txt", "a_5.txt", "a_2_2.txt", "a_4.txt"] and got[13] == "a_6.txt"
    assert files.unique_names(df.limit(0), ["at"]).count() == 0 and files.registered(df).count() == len(set(given))


def test_verdicts_and_uploads(spark):
    whole = packed({"a.txt": b"one", "../b.txt": b"two"})
    broken = bytearray(packed({"a.txt": b"one" * 50, "b.txt": b"two"}))
    broken[40] ^= 1
    rows = files.unzip(spark.createDataFrame([("w.zip", bytearray(whole)), ("b.zip", broken), ("n.zip", bytearray(b"no"))], files.FILE))
    got = {r["archive"]: (r["valid"], r["members"], r["broken"], r["first_broken"]) for r in files.verdicts(rows).collect()}
    assert got == {"w.zip": (True, 2, 0, None), "b.zip": (False, 2, 1, "a.txt"), "n.zip": (False, 0, 1, "")}
    assert [one(spark, files.contained(F.lit(n)).alias("x"))["x"] for n in ("a", "..", ".", " ", ".._b.txt")] == [True, False, False, False, True]
    df = spark.createDataFrame([("a.exe",), ("._b.txt",), ("c.PDF",), ("d",), ("e.exe",)], "name string").withColumn("content", F.lit(b""))
    assert [r["x"] for r in files.bag(df, df).select(files.skipped(F.col("name")).alias("x")).collect()][:4] == ["Unsupported file type .exe", "junk", None, "Unsupported file type ."]
    assert {(r["ext"], r["files"]) for r in files.unsupported(df).collect()} == {("exe", 2), ("", 1)}


def test_reports_and_requests(spark, tmp_path):
    found = spark.createDataFrame([("1/collection_meta.json", "{}"), ("1/reports/latency_report.json", "{"), ("1/outputs/ranking_results.csv", "a,b")], "path string, text string")
    got = {r["report"]: (r["content"], r["error"]) for r in files.reports(spark.createDataFrame([("1",)], "collection string"), found).collect()}
    assert len(got) == len(config.REPORT_PATHS) and got["meta"] == ("{}", None) and got["latency"] == (None, "Invalid JSON report")
    assert got["ranking_csv"] == ("a,b", None) and got["validation"] == (None, "Report not found")
    assert config.checked_request(" x ", 1, 500, offset=0, score=1.0, position=1)["description"] == "x"
    for bad in ({"description": " "}, {"top_k": 0}, {"limit": 501}, {"limit": 0}, {"offset": -1}, {"score": 1.1}, {"position": 0}):
        with pytest.raises(ValueError):
            config.checked_request(**bad)
    old = F.lit("2026-01-01 00:00:00").cast("timestamp")
    young, gone = sinks.fresh(spark.range(1).select(old.alias("at")), "at", F.lit("2026-01-01 01:00:00").cast("timestamp"))
    assert (young.count(), gone.count()) == (1, 0)


def test_prompt(spark):
    c = F.array(F.struct(F.lit("a.txt").alias("filename"), F.lit(None).cast("int").alias("rank"), F.lit(0.5).alias("score"), F.array(*map(F.lit, "abcdefg")).alias("skills"), F.lit("100%").alias("excerpt")))
    text = one(spark, X.user_prompt(F.lit("who?"), c).alias("x"))["x"]
    assert text == "Candidates:\nCandidate 1:\n- Filename: a.txt\n- Rank: N/A\n- Score: 0.5\n- Skills: a, b, c, d, e\n- Excerpt: 100%\n\nQuestion: who?\nAnswer based on the candidates above:"
    assert one(spark, X.user_prompt(F.lit("who?"), F.slice(c, 2, 1)).alias("x"))["x"] == "who?"


@pytest.mark.parametrize(("n", "pages", "ok"), [(100, 1, True), (99, 1, False), (150, 2, True), (150, 4, False), (100, 0, True)])
def test_direct_text(spark, n, pages, ok):
    assert one(spark, files.direct_text_ok(F.lit("x" * n), F.lit(pages)).alias("ok"))["ok"] is ok


def test_sinks(spark, tmp_path):
    old, new = (spark.createDataFrame(r, "k int, v int, x string") for r in ([(1, 1, "a"), (2, 5, "b")], [(1, 2, "c"), (2, 4, "d"), (3, None, "e")]))
    assert sorted(r["x"] for r in sinks.upserted(old, new, ["k"], "v").collect()) == ["b", "c", "e"]
    assert [r["k"] for r in sinks.without(old, new.where("k = 1"), ["k"]).collect()] == [2]
    path = str(tmp_path / "t")
    sinks.replace_partitions(old, path, "k")
    sinks.replace_partitions(new.where("k = 2"), path, "k")
    assert sorted((r["k"], r["x"]) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "d")]
    sinks.export_csv(old, str(tmp_path / "csv"), [F.col("v").desc()])
    assert [r["x"] for r in spark.read.csv(str(tmp_path / "csv"), header=True).collect()] == ["b", "a"]
    assert [r["mode"] for r in sinks.backfilled(old, "mode", "keyword").collect()] == ["keyword", "keyword"]
    assert sinks.vector_meta(spark.createDataFrame([([1.0, 2.0],), (None,)], "v array<double>"), "v").first() == (2, 1)


def test_stream_takes_only_what_is_new(spark, tmp_path):
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for batch in ([(1, "a"), (2, "a")], [(3, "a"), (4, "b")]):
        spark.createDataFrame(batch, "doc_id long, text string").coalesce(1).write.mode("append").parquet(source)
        ingest.run_once(ingest.first_seen(ingest.stream(spark, source, "doc_id long, text string")), sink, state)
    assert sorted(r["text"] for r in spark.read.parquet(sink).collect()) == ["a", "b"]


def test_sections(spark):
    text = "jane, 30\nSKILLS: python\nsql\n\nOther Heading\nlost\nWork Experience\nat Acme\nSkills\nspark\n"
    assert one(spark, S.by_lines(F.lit(text)).alias("s"))["s"] == {"other": "jane, 30", "skills": "sql\n\nspark", "experience": "at Acme"}
    got = one(spark, S.anywhere(F.lit("Hi. Experience: a Education b")).alias("s"))["s"]
    assert [(s["section"], s["text"]) for s in got] == [("general", "Hi."), ("experience", ": a"), ("education", "b")]
    assert one(spark, S.anywhere(F.lit(None).cast("string")).alias("s"), S.by_lines(F.lit("")).alias("m")) == ([], {})


def test_entities(spark):
    text = "Worked on python, Python and machine learning"
    got = one(spark, E.skill_mentions(F.lit(text), config.SKILLS).alias("s"))["s"]
    assert [(s["skill"], s["count"], s["confidence"]) for s in got] == [("machine learning", 1, 0.1667), ("python", 2, 0.3333)]
    assert one(spark, E.normalize_degree(F.lit(" M. Tech ")).alias("d"))["d"] == "mtech"
    assert one(spark, E.skill_mentions(F.lit(""), config.SKILLS).alias("s"))["s"] == []


def test_golden_values(spark):
    when = F.lit("2026-01-01").cast("date")
    depth = [one(spark, D.experience_depth(F.lit(y).cast("double")).alias("x"))["x"] for y in (0, 5, 10, 25, None)]
    assert depth == [0, 0.5, 1, 1, 0]
    assert [one(spark, D.stability(F.lit(n)).alias("x"))["x"] for n in (0, 1, 5, 10)] == [1, 0.8333, 0.5, 0.3333]
    months = [one(spark, D.ranges(F.lit(t), when).alias("r"))["r"][0]["months"] for t in ("Jun 2018 - Dec 2020", "Aug 2016 – May 2018", "Jan 2020 - Jan 2019")]
    assert months == [31, 22, 0]
    assert one(spark, D.experience_score(F.lit(8.42), F.lit(1.0)).alias("x"))["x"] == pytest.approx(0.8663, abs=1e-4)
    assert one(spark, X.slugify(F.lit(" Acme, Corp_One ")).alias("x"))["x"] == "acme-corp-one"
    assert [len(one(spark, X.char_windows(F.lit("x" * n)).alias("x"))["x"]) for n in (5000, 2000, 0)] == [3, 1, 0]
    assert [len(one(spark, X.word_windows(F.lit("x " * n)).alias("x"))["x"]) for n in (700, 307)] == [3, 1]
    with pytest.raises(ValueError):
        config.checked_weights({"semantic": 0.98, "skill_match": 0, "experience": 0, "education": 0})
