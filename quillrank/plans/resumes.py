"""Files of whole résumés, page files, and models in their slots: from contents to tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank import config
from quillrank.functions import text as X
from quillrank.operators import indexing as I
from quillrank.operators import models as M
from quillrank.operators import ranking as R
from quillrank.plans.base import query, table
from quillrank.session import scratch_folder
from quillrank.sources import readers

#: Skills that the résumés have: five of these in a row, from a place that depends on the number.
SKILLS = [v for v in config.SKILLS if " " not in v]
DEGREES = ["Master of Science, Computer Science", "Bachelor of Science, Data Science", "PhD, Machine Learning", "MBA"]
ROLES = ["Senior Software Engineer", "Data Scientist", "Backend Engineer", "Product Manager"]


def _resume(k: Column) -> Column:
    """A résumé of the shape that people send in, with numbers, skills, roles and degrees that depend on k. Its own number
    has nine digits, so that it is never read as a year."""
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), n.cast("int"))
    skills = F.array_join(F.slice(F.array(*map(F.lit, SKILLS * 2)), (k % len(SKILLS)).cast("int") + 1, 5), ", ")
    year, own = 1990 + k % 20, F.format_string("%09d", k)
    return F.concat(
        F.lit("CANDIDATE "), own, F.lit("\n\nSUMMARY\nBuilds systems, number "), own, F.lit(".\n\nWORK EXPERIENCE\n"), pick(ROLES, k % 4), F.lit(", NovaPay\nJan "), year.cast("string"),
        F.lit(" - Dec "), (year + 3 + k % 5).cast("string"), F.lit("\n\nEDUCATION\n"), pick(DEGREES, k % 7 % 4), F.lit("\n\nSKILLS\n"), skills, F.lit("\n\nPROJECTS\nA pagination library, release "), (k % 9).cast("string"), F.lit("\n"),
    )


def _docx(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    for batch in batches:
        out = []
        for text in batch["text"]:
            body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in text.split("\n"))
            packed = io.BytesIO()
            with zipfile.ZipFile(packed, "w") as z:
                z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
            out.append(packed.getvalue())
        yield pd.DataFrame({"name": batch["name"], "content": out})


def _files(spark: SparkSession, d: str) -> DataFrame:
    """A file a document's number: a fifth each as docx, as a page file that none can read, and blank; a third are copies of
    the one five before."""
    k = F.col("doc_id")
    own = table(spark, d, "documents").select(k, F.when((k % 3 == 0) & (k > 5), k - 5).otherwise(k).alias("of"))
    kind = F.get(F.array(*map(F.lit, ["docx", "txt", "pdf", "txt", "txt"])), (k % 5).cast("int"))
    rows = own.select(F.format_string("cv%09d.", k).alias("stem"), kind.alias("kind"), F.when(k % 5 == 3, F.lit(" \n\t ")).otherwise(_resume(F.col("of"))).alias("text"))
    rows = rows.select(F.concat("stem", "kind").alias("name"), "kind", "text")
    plain = rows.where("kind != 'docx'").select("name", F.col("text").cast("binary").alias("content"))
    return plain.unionByName(rows.where("kind = 'docx'").select("name", "text").mapInPandas(_docx, "name string, content binary"))


_LIST = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
_KIND = "['docx', 'txt', 'pdf', 'txt', 'txt'][k % 5 + 1]"


@query(f"""WITH c AS (SELECT doc_id AS k, CASE WHEN doc_id % 3 = 0 AND doc_id > 5 THEN doc_id - 5 ELSE doc_id END AS f FROM documents),
  n AS (SELECT *, printf('cv%09d.', k) || {_KIND} AS name, CASE WHEN k % 5 = 2 THEN 'FAILED' WHEN k % 5 = 3 THEN 'EMPTY' END AS kind FROM c),
  s AS (SELECT *, CASE WHEN kind IS NULL THEN min(name) OVER (PARTITION BY kind, f, k % 5 = 0) END AS first FROM n),
  o AS (SELECT *, coalesce(kind, CASE WHEN first < name THEN 'DUPLICATE' ELSE 'OK' END) AS status FROM s),
  x AS (SELECT *, status = 'OK' AS ok, list_transform(range(f % {len(SKILLS)}, f % {len(SKILLS)} + 5), lambda i: ({_LIST(SKILLS)})[i % {len(SKILLS)} + 1]) AS skills, 1990 + f % 20 AS y FROM o)
  SELECT name, status, CASE status WHEN 'FAILED' THEN 'Processing failed: no reader for pdf' WHEN 'EMPTY' THEN 'Validation failed' WHEN 'DUPLICATE' THEN 'Duplicate of ' || first END AS reason, CASE WHEN status = 'DUPLICATE' THEN first END AS duplicate_of,
    CASE WHEN ok THEN CASE WHEN k % 5 = 0 THEN '' ELSE array_to_string(skills, ', ') END END AS skills_section, CASE WHEN ok THEN array_to_string(list_sort(skills), ',') END AS skills, CASE WHEN ok THEN y END AS earliest, CASE WHEN ok THEN y + 3 + f % 5 END AS latest,
    count(*) OVER (PARTITION BY status) AS with_status FROM x""")
def process_files(spark: SparkSession, d: str) -> DataFrame:
    """Files through text extraction, validation, duplicates, sections, entities and experience into side tables, which are
    read back. A docx file's text has no lines, and so no sections."""
    path = scratch_folder(spark)
    checked = I.write_processed(_files(spark, d), path, SKILLS)
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    counts = checked.groupBy("status").agg(F.count("*").alias("with_status"))
    out = checked.join(counts, "status").join(read("duplicates"), "name", "left").join(read("sections").select("name", F.col("skills").alias("skills_section")), "name", "left")
    out = out.join(read("entities").select("name", F.array_join(F.array_sort(F.map_keys("skills")), ",").alias("skills")), "name", "left")
    out = out.join(read("experience").select("name", F.col("earliest").cast("long").alias("earliest"), F.col("latest").cast("long").alias("latest")), "name", "left")
    return out.select("name", "status", "reason", "duplicate_of", "skills_section", "skills", "earliest", "latest", "with_status")


@query(f"""WITH c AS (SELECT doc_id AS k, CASE WHEN doc_id % 3 = 0 AND doc_id > 5 THEN doc_id - 5 ELSE doc_id END AS f FROM documents),
  s AS (SELECT *, k % 5 = 3 AS blank, CASE WHEN k % 5 <> 3 THEN min(k) OVER (PARTITION BY f, k % 5 = 3) END AS first FROM c), o AS (SELECT *, NOT blank AND first = k AS ok FROM s)
  SELECT k AS candidate, CASE WHEN blank THEN 'failed' WHEN first < k THEN 'duplicate' ELSE 'processed' END AS status, CASE WHEN blank THEN 'text_extraction: Extracted text too short (0 chars)' END AS reason,
    CASE WHEN ok THEN array_to_string(list_sort(list_transform(range(f % {len(SKILLS)}, f % {len(SKILLS)} + 5), lambda i: ({_LIST(SKILLS)})[i % {len(SKILLS)} + 1])), ',') END AS skills,
    CASE WHEN ok THEN ['Senior,Software Engineer', 'Data Scientist', 'Backend Engineer', 'Product Manager'][f % 4 + 1] END AS titles, CASE WHEN ok THEN 4 + f % 5 END::double AS years, CASE WHEN ok THEN 1993 + f % 20 + f % 5 END AS last_year,
    CASE WHEN ok THEN [3, 2, 4, 3][f % 7 % 4 + 1] END AS tier, CASE WHEN ok THEN 'general' END AS chunks_of FROM o""")
def resume_index(spark: SparkSession, d: str) -> DataFrame:
    """Index rows of whole résumés: skills, titles, experience, education and chunks from the sections of each text."""
    k = F.col("doc_id")
    own = table(spark, d, "documents").select(k, F.when((k % 3 == 0) & (k > 5), k - 5).otherwise(k).alias("of"))
    text = F.when(k % 5 == 3, F.lit(" \n\t ")).otherwise(_resume(F.col("of")))
    files = own.select(F.lit(1).alias("company"), (k % 5).alias("job"), k.alias("candidate"), text.alias("text"), F.lit(None).cast("string").alias("error"))
    rows = I.indexed(files, F.to_date(F.lit("2026-01-01")), SKILLS)
    return rows.select(
        "candidate", "status", "reason", F.array_join("extracted_skills", ",").alias("skills"), F.array_join("job_titles", ",").alias("titles"), F.col("experience.years").cast("double").alias("years"),
        F.year("experience.latest").cast("long").alias("last_year"), F.col("education.tier").cast("long").alias("tier"), F.array_join(F.array_distinct(F.transform("chunks", lambda c: c["section"])), ",").alias("chunks_of"),
    )


def _page_reader(content: bytes) -> tuple[str, int]:
    text = content.decode()
    if text.startswith("broken"):
        raise ValueError("no header")
    return text[:60] if text.startswith("scan") else text, 1 + len(text) // 4_000


def _rough_reader(content: bytes) -> tuple[str, int]:
    return content.decode()[6:], 1


def _no_reader():
    raise ImportError("not here")


def _engine(content: bytes) -> str:
    text = content.decode()
    if text.startswith("scan 1"):
        raise ValueError("blurred")
    return "" if text.startswith("scan 2") else text[5:]


def _second_engine(content: bytes) -> str:
    if content.startswith(b"scan 2"):
        return "  "
    return content.decode()[:30]


@query(r"""WITH p AS (SELECT page_id, CASE WHEN page_id % 5 < 3 THEN 'scan ' || page_id % 5 || ' ' WHEN page_id % 5 = 3 THEN 'broken' ELSE '' END || html AS t FROM pages),
  d AS (SELECT *, regexp_replace(CASE WHEN page_id % 5 < 3 THEN substr(t, 1, 60) WHEN page_id % 5 = 3 THEN substr(t, 7) ELSE t END, '^\s+|\s+$', '', 'g') AS own, CASE WHEN page_id % 5 = 3 THEN 1 ELSE 1 + length(t) // 4000 END AS pages FROM p),
  g AS (SELECT *, length(own) >= 100 AND length(own) / pages >= 50 AS enough FROM d)
  SELECT 'p' || page_id || '.pdf' AS name, pages::int AS pages, CASE WHEN enough THEN 'direct' WHEN page_id % 5 IN (1, 2) THEN 'ocr_fallback' ELSE 'ocr_primary' END AS method, CASE WHEN enough THEN 'TEXT_EXTRACTED' WHEN page_id % 5 = 2 THEN 'OCR_FAILED' ELSE 'OCR_DONE' END AS state,
    NOT enough AS ocr_triggered, length(CASE WHEN enough OR page_id % 5 = 2 THEN own WHEN page_id % 5 = 1 THEN regexp_replace(substr(t, 1, 30), '^\s+|\s+$', '', 'g') ELSE regexp_replace(substr(t, 6), '^\s+|\s+$', '', 'g') END) AS char_count,
    CASE WHEN NOT enough AND page_id % 5 = 2 THEN 'primary: primary OCR returned no text' END AS failure_reason FROM g""")
def extraction_states(spark: SparkSession, d: str) -> DataFrame:
    """Pages as page files through a cascade of readers, one of which isn't installed, and, where these give too little,
    through two engines: stand-ins with the faults of real ones."""
    k = F.col("page_id")
    head = F.when(k % 5 < 3, F.concat(F.lit("scan "), (k % 5).cast("string"), F.lit(" "))).when(k % 5 == 3, "broken").otherwise("")
    files = table(spark, d, "pages").select(F.format_string("p%d.pdf", k).alias("name"), F.concat(head, "html").cast("binary").alias("content"))
    found = readers.extracted(files, [("absent", _no_reader), ("first", lambda: _page_reader), ("second", lambda: _rough_reader)], lambda: _engine, lambda: _second_engine)
    return found.drop("text")


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _letters():
    """A stand-in for an encoder: how often each letter occurs."""
    return lambda texts: np.array([[t.count(c) for c in LETTERS] for t in texts], dtype=np.float64)


_COUNTS = "list_transform(string_split('" + LETTERS + "', ''), lambda c: (length({0}) - length(replace({0}, c, '')))::double)".format("t")


@query(f"""WITH c AS (SELECT doc_id, i, substr(text, i * 1800 + 1, 2000) AS t FROM (SELECT doc_id, text, unnest(range(0, greatest(ceil((length(text) - 200) / 1800.0)::int, 1))) AS i FROM documents WHERE length(text) > 0)),
  e AS (SELECT doc_id, i, {_COUNTS} AS v FROM c), j AS (SELECT item_id, v AS w FROM (SELECT item_id, text AS t, {_COUNTS} AS v FROM benchmark)),
  n AS (SELECT doc_id, i, list_transform(v, lambda x: (x / sqrt(list_dot_product(v, v)))::float) AS v FROM e WHERE list_dot_product(v, v) > 0), m AS (SELECT item_id, list_transform(w, lambda x: (x / sqrt(list_dot_product(w, w)))::float) AS w FROM j WHERE list_dot_product(w, w) > 0),
  s AS (SELECT item_id, doc_id, i, round(greatest(2 - 2 * list_dot_product(v::double[], w::double[]) / (sqrt(list_dot_product(v::double[], v::double[])) * sqrt(list_dot_product(w::double[], w::double[]))), 0), 6) AS d2 FROM n, m)
  SELECT item_id, doc_id, i AS chunk, round(1 / (1 + d2), 4) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY d2, doc_id * 100000 + i) <= 10""")
def encoded_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Documents cut into windows, encoded in batches in the encoder's slot, and the ten nearest windows of each
    description (the limit is the feature)."""
    windows = table(spark, d, "documents").select("doc_id", F.posexplode(X.char_windows(F.col("text"))).alias("chunk", "w")).select((F.col("doc_id") * 100_000 + F.col("chunk")).alias("id"), F.col("w.chunk").alias("text"))
    rows = windows.select("id", M.encoded(F.col("text"), _letters).alias("vec"))
    rows.write.parquet(at := f"{scratch_folder(spark)}/vectors")
    rows = spark.read.schema(rows.schema).parquet(at).where("vec IS NOT NULL")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("q"), M.encoded(F.col("text"), _letters).alias("q_vec")).where("q_vec IS NOT NULL")
    near = R.nearest_l2(rows, asked, 10)
    return near.select(F.col("q").alias("item_id"), F.call_function("div", F.col("id"), F.lit(100_000)).alias("doc_id"), (F.col("id") % 100_000).alias("chunk"), "similarity")


def _capitals():
    """A stand-in for a tagger: words of four letters or more with a capital."""
    import re

    one = re.compile(r"(?<![^ ])[A-Z][a-z]{3,}(?![^ ])")
    return lambda text: [(m[0], "long" if len(m[0]) > 6 else "short") for m in one.finditer(text)]


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM documents), u AS (SELECT doc_id, i, ws[i] AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
  c AS (SELECT doc_id, lower(w) AS l, CASE WHEN length(w) > 6 THEN 'long' ELSE 'short' END AS label, arg_min(w, i) AS w, min(i) AS nth FROM u WHERE regexp_full_match(w, '[A-Z][a-z]{3,}') GROUP BY 1, 2, 3)
  SELECT doc_id, count(nth) AS entities, coalesce(string_agg(w || '/' || label, ' ' ORDER BY nth), '') AS found FROM documents LEFT JOIN c USING (doc_id) GROUP BY 1""")
def entity_windows(spark: SparkSession, d: str) -> DataFrame:
    """A tagger over overlapping windows of whole documents gives what one pass over the text gives."""
    found = M.entities(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", _capitals)
    return found.select("doc_id", F.size("entities").cast("long").alias("entities"), F.array_join(F.transform("entities", lambda e: F.concat(e["word"], F.lit("/"), e["label"])), " ").alias("found"))
