"""Whole passes over files: processing with validation and entities, index rows, chunk indices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.functions import dates as D
from quillrank.functions import entities as E
from quillrank.functions import text as X
from quillrank.operators import indexing as I
from quillrank.operators import records as M
from quillrank.plans.base import query, spread, table
from quillrank.sources import sinks

AS_OF = "2026-01-01"


@query("""WITH r AS (SELECT 'f' || lpad(doc_id::varchar, 9, '0') || '.txt' AS name, text, CASE doc_id % 50 WHEN 7 THEN 'Failed to extract text: x' WHEN 9 THEN 'odd' END AS error FROM documents),
  k AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'FAILED' WHEN length(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) = 0 THEN 'EMPTY' END AS kind FROM r),
  f AS (SELECT *, CASE WHEN kind IS NULL THEN min(name) OVER (PARTITION BY kind IS NULL, text) END AS first FROM k)
  SELECT name, coalesce(kind, CASE WHEN first <> name THEN 'DUPLICATE' ELSE 'OK' END) AS status, CASE WHEN kind = 'FAILED' THEN CASE WHEN error = 'odd' THEN 'Processing failed: odd' ELSE 'Extraction error: ' || error END WHEN kind = 'EMPTY' THEN 'Validation failed'
    WHEN first <> name THEN 'Duplicate of ' || first END AS reason, CASE WHEN first <> name THEN first END AS duplicate_of FROM f""")
def process_collection(spark: SparkSession, d: str) -> DataFrame:
    return _processed(spark, d).select("name", "status", "reason", "duplicate_of")


def _processed(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 50
    error = F.when(k == 7, "Failed to extract text: x").when(k == 9, "odd")
    return I.processed(table(spark, d, "documents").select(F.format_string("f%09d.txt", "doc_id").alias("name"), "text", error.alias("error")))


@query("""WITH r AS (SELECT doc_id, text, CASE WHEN doc_id % 50 IN (7, 9) THEN 'FAILED' WHEN length(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) = 0 THEN 'EMPTY' END AS kind FROM documents)
  SELECT count(*) AS total_files, count(DISTINCT CASE WHEN kind IS NULL THEN text END) AS ok, count(*) FILTER (kind = 'FAILED') AS failed, count(*) FILTER (kind = 'EMPTY') AS empty, count(*) FILTER (kind IS NULL) - count(DISTINCT CASE WHEN kind IS NULL THEN text END) AS duplicate FROM r""")
def processing_stats(spark: SparkSession, d: str) -> DataFrame:
    return I.processing_stats(_processed(spark, d))


_STORY = [
    "Senior Data Engineer at {brand} from Jan {y} - Dec 2018 where the team built things with {name} and python every day of the week.",
    "Then Software Architect from Mar 2019 - Present in a place by the sea with docker and sql for everyone who asked.",
]


def _resume() -> Column:
    """A text of four sections from a part's columns; every seventh is too short and every eleventh the same."""
    start = (F.lit(2010) + F.col("p_partkey") % 8).cast("string")
    told = [F.replace(F.replace(F.replace(F.lit(s), F.lit("{brand}"), F.col("p_brand")), F.lit("{name}"), F.col("p_name")), F.lit("{y}"), start) for s in _STORY]
    whole = F.concat(F.lit("  About me: likes "), F.col("p_name"), F.lit(".\nWork experience\n"), told[0], F.lit("\n"), told[1], F.lit("\nEducation: Bachelor of Arts and a diploma.\nSkills: Machine Learning, rest, "), F.col("p_name"), F.lit(" \n"))
    same = F.lit("Nothing but words without any heading, told again and again by the same people to the same people, year after year until the end.")
    return F.when(F.col("p_partkey") % 7 == 3, "too short").when(F.col("p_partkey") % 11 == 5, same).otherwise(whole)


_SKILLED = "list_sort(list_distinct(list_concat(CASE WHEN p_partkey % 11 = 5 THEN [] ELSE ['docker', 'machine learning', 'python', 'rest', 'sql'] END, CASE WHEN p_partkey % 2 = 0 THEN ['kafka', 'sql'] ELSE ['kafka'] END)))"


@query(f"""WITH b AS (SELECT *, p_partkey % 3 AS job, CASE WHEN p_partkey % 13 = 1 THEN 'failed' WHEN p_partkey % 7 = 3 THEN 'failed' WHEN p_partkey > min(CASE WHEN p_partkey % 7 <> 3 AND p_partkey % 13 <> 1 THEN p_partkey END) OVER (PARTITION BY p_partkey % 3, CASE WHEN p_partkey % 11 = 5 THEN 'same' ELSE p_name || p_brand || (p_partkey % 8) END) THEN 'duplicate' ELSE 'processed' END AS status FROM part)
  SELECT job, p_partkey AS candidate, status, CASE WHEN p_partkey % 13 = 1 THEN 'text_extraction: File not found' WHEN p_partkey % 7 = 3 THEN 'text_extraction: Extracted text too short (9 chars)' END AS reason,
  CASE WHEN status = 'processed' THEN array_to_string({_SKILLED}, ',') END AS skills, CASE WHEN status = 'processed' THEN CASE WHEN p_partkey % 11 = 5 THEN '' ELSE 'Senior' END END AS titles,
  CASE WHEN status = 'processed' THEN CASE WHEN p_partkey % 11 = 5 THEN 0.0 ELSE round(((2018 - 2010 - p_partkey % 8) * 12 + 12 + 83) / 12.0::double, 2) END END AS years, CASE WHEN status = 'processed' AND p_partkey % 11 <> 5 THEN DATE '2026-01-01' END AS latest,
  CASE WHEN status = 'processed' THEN CASE WHEN p_partkey % 11 = 5 THEN 0 ELSE 2 END END AS tier, CASE WHEN status = 'processed' THEN CASE WHEN p_partkey % 11 = 5 THEN 'general' ELSE 'experience' END END AS chunk_sections,
  CASE WHEN status = 'processed' THEN CASE WHEN p_partkey % 11 = 5 THEN 1 ELSE 4 END END AS sections FROM b""")
def index_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Index rows of files, kept by candidate: a second run over some of them leaves one row each."""
    error = F.when(F.col("p_partkey") % 13 == 1, "File not found")
    named = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit(" SQL"), F.lit("Kafka"), F.lit("x"))).otherwise(F.array(F.lit("kafka")))
    files = table(spark, d, "part").select(F.lit(1).alias("company"), (F.col("p_partkey") % 3).alias("job"), F.col("p_partkey").alias("candidate"), _resume().alias("text"), error.alias("error"), named.alias("named"))
    rows = I.indexed(files, F.lit(AS_OF).cast("date"), named=F.col("named"))
    both = sinks.upserted(rows.withColumn("version", F.lit(1)), rows.where("candidate % 4 = 0").withColumn("version", F.lit(2)), ["candidate"], "version")
    years, join = F.col("experience.years"), lambda c: F.array_join(c, ",")
    return both.select(
        "job", "candidate", "status", "reason", join(F.col("extracted_skills")).alias("skills"), join(F.col("job_titles")).alias("titles"), years.alias("years"), F.col("experience.latest").alias("latest"),
        F.col("education.tier").alias("tier"), join(F.array_distinct(F.col("chunks.section"))).alias("chunk_sections"), F.when(F.col("sections").isNotNull(), F.size("sections")).alias("sections"),
    )


@query("""SELECT p_partkey, 'M. Tech in Computer  Science' AS education, (['Senior Software Engineer since 2015', 'Data  Scientist in 2011, 2019 and 20190', '', ''])[p_partkey % 4 + 1] AS other,
  'python' AS skills, (['senior software engineer|software engineer', 'data scientist', '', 'quiet developer'])[p_partkey % 4 + 1] AS roles, 'amazon|microsoft' AS organizations, 'mtech' AS degree, 'computer science' AS field,
  ([0, 8, NULL, 0])[p_partkey % 4 + 1] AS years, ([0.0, 0.8, 0.0, 0.0])[p_partkey % 4 + 1]::double AS depth, ([0.7143, 0.8333, 1.0, 0.8333])[p_partkey % 4 + 1]::double AS stability FROM part""")
def resume_intelligence(spark: SparkSession, d: str) -> DataFrame:
    """Sections, entities of rules and of a model, in their canonical forms, and signals of experience."""
    tale = F.get(F.array(*map(F.lit, ["Senior Software Engineer since 2015", "Data  Scientist in 2011, 2019 and 20190", "Manager", "Quiet Developer 1899 2001"])), (F.col("p_partkey") % 4).cast("int"))
    text = F.concat(tale, F.lit("\nEducation\nM. Tech in Computer  Science\nSkills\nworked with python, Python 3 and "), F.col("p_name"))
    rows = spread(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey").select("p_partkey", text.alias("text"))
    found = I.intelligence(F.col("text"), ["python", "sql"], organizations=F.array(F.lit("Microsoft Azure"), F.lit("Amazon Web Services Inc.")))
    r = rows.select("p_partkey", found.alias("r")).select("p_partkey", "r.*")
    return r.select(
        "p_partkey", F.col("sections.education").alias("education"), F.col("sections.other").alias("other"), F.array_join(F.map_keys("entities.skills"), "|").alias("skills"), F.array_join("entities.roles", "|").alias("roles"),
        F.array_join("entities.organizations", "|").alias("organizations"), F.col("entities.degree").alias("degree"), F.lower(F.regexp_replace("field", r"\\s+", " ")).alias("field"), F.col("experience.years_max").alias("years"),
        F.col("experience.experience_depth").alias("depth"), F.col("experience.stability").alias("stability"),
    )


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '1998,2003' ELSE '2003' END AS years, CASE WHEN o_orderkey % 2 = 0 THEN 5 ELSE 0 END AS span FROM orders""")
def year_extract(spark: SparkSession, d: str) -> DataFrame:
    """Years on their own; digits that go on, and years out of range, are none."""
    text = F.when(F.col("o_orderkey") % 2 == 0, "from Mar 1998 to 05/2003 (no. 20011, 1850)").otherwise("2003-05, 2003; x2001 and 2150")
    span = D.year_span(text)
    return table(spark, d, "orders").select("o_orderkey", F.array_join(D.years(text), ",").alias("years"), span["years_max"].alias("span"))


@query("""SELECT p_partkey, (['data analyst', 'lead engineer', '', 'chief'])[p_partkey % 4 + 1] AS roles, (['a|b|c', 'b|c', 'b|c', 'b|c'])[p_partkey % 4 + 1] AS names FROM part""".replace("'chief'", "''"))
def entity_union(spark: SparkSession, d: str) -> DataFrame:
    """Role words after a capitalised word, and a field of two sources as one list."""
    k = (F.col("p_partkey") % 4).cast("int")
    text = F.get(F.array(*map(F.lit, ["our Data  analyst", "the Lead Engineer", "an engineer", "Old Manage rs"])), k)
    names = M.union_of(F.array(F.lit("c"), F.lit("b")), F.when(k == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(I.none()))
    return table(spark, d, "part").select("p_partkey", F.array_join(E.title_roles(text), "|").alias("roles"), F.array_join(names, "|").alias("names"))


@query("""WITH w AS (SELECT doc_id, text, unnest(range(0, greatest(ceil((length(text) - 200) / 1800.0)::int, 1))) AS i FROM documents WHERE length(text) > 0)
  SELECT 'd' || doc_id || '.txt' AS filename, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS nth, substr(substr(text, i * 1800 + 1, 2000), 1, 200) AS shown, count(*) OVER (PARTITION BY doc_id) AS chunks FROM w""")
def chunk_index(spark: SparkSession, d: str) -> DataFrame:
    """Windows of each file with their number, as a retrieval index keeps them, and the 200 characters that are shown."""
    rows = table(spark, d, "documents").select(F.format_string("d%d.txt", "doc_id").alias("filename"), X.char_windows(F.col("text")).alias("ws"))
    one = rows.select("filename", F.size("ws").cast("long").alias("chunks"), F.posexplode("ws").alias("nth", "w"))
    return one.select("filename", F.col("nth").cast("long").alias("nth"), F.substring("w.chunk", 1, 200).alias("shown"), "chunks")
