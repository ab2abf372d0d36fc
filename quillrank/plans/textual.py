"""Texts: skills, chunks, windows, terms, names and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank import config
from quillrank.functions import dates as D
from quillrank.functions import text as X
from quillrank.operators import grams as G
from quillrank.operators.sections import tasks, text_bytes, whole
from quillrank.plans.base import query, table
from quillrank.plans.sql import grams_sql, words_sql
from quillrank.session import small_batches

#: Bytes of text whose grams a task counts, and whose words are sent together.
TEXT, CHUNK = 8 << 20, 16 << 20
VOCABULARY = [*config.SKILLS, "license", "mit", "the and"]
_VOCAB_SQL = "[" + ", ".join(f"'{v}'" for v in VOCABULARY if " " not in v) + "]"
_PHRASE_SQL = "[" + ", ".join(f"'{v}'" for v in VOCABULARY if " " in v) + "]"
_NORM = "trim(regexp_replace(replace(replace(replace(replace(lower(text), 'c++', 'cpp'), 'c#', 'csharp'), 'node.js', 'nodejs'), 'ci/cd', 'cicd'), '[^\\p{L}\\p{N}_]+', ' ', 'g'))"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(f"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(list_filter({_VOCAB_SQL}, lambda v: list_contains(string_split(n, ' '), v)), list_filter({_PHRASE_SQL}, lambda p: contains(n, p))))), ',') AS skills
  FROM (SELECT doc_id, {_NORM} AS n FROM documents)""")
def skill_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(X.extract_skills(F.col("text"), VOCABULARY), ",").alias("skills"))


@query(r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(p_name || ', ' || p_brand || '_' || p_type)), '[\s_]+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '-') AS slug FROM part""")
def slugify(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.col("p_name"), F.lit(", "), F.col("p_brand"), F.lit("_"), F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", X.slugify(name).alias("slug"))


@query("""WITH w AS (SELECT doc_id, text, unnest(range(0, greatest(ceil((length(text) - 200) / 1800.0)::int, 1))) AS i FROM documents WHERE length(text) > 0)
  SELECT doc_id, i * 1800 AS start, sha256(substr(text, i * 1800 + 1, 2000)) AS chunk FROM w""")
def char_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.explode(X.char_windows(F.col("text"))).alias("w"))
    return rows.select("doc_id", F.col("w.start").cast("long").alias("start"), F.sha2("w.chunk", 256).alias("chunk"))


@query(r"""WITH s AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS ws FROM documents), w AS (SELECT doc_id, ws, unnest(range(0, greatest(ceil((len(ws) - 38) / 269.0)::int, 1))) AS i FROM s WHERE len(ws) > 0)
  SELECT doc_id, sha256(array_to_string(list_slice(ws, i * 269 + 1, i * 269 + 307), ' ')) AS chunk FROM w""")
def word_windows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.explode(X.word_windows(F.col("text"))).alias("w")).select("doc_id", F.sha2("w", 256).alias("chunk"))


@query(r"""WITH RECURSIVE s AS (SELECT doc_id, list_filter(string_split(regexp_replace(replace(text, '.' || chr(10), '. '), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: length(regexp_replace(x, '^\s+|\s+$', '', 'g')) > 0) AS ss FROM documents),
  u AS (SELECT doc_id, i, regexp_replace(ss[i], '^\s+|\s+$', '', 'g') AS t FROM (SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM s)), n AS (SELECT doc_id, i, t, len(list_filter(string_split_regex(t, '\s+'), lambda w: w <> '')) AS w FROM u),
  f AS (SELECT doc_id, i, t, w, CASE WHEN w * 1.3::double >= 200 THEN w ELSE NULL END AS out_w, CASE WHEN w * 1.3::double >= 200 THEN 0 ELSE w END AS acc, 0::bigint AS before FROM n WHERE i = 1
    UNION ALL SELECT n.doc_id, n.i, n.t, n.w, CASE WHEN b.nw * 1.3::double >= 200 THEN b.nw END, CASE WHEN b.nw * 1.3::double >= 200 THEN 0 ELSE b.nw END, b.emitted
    FROM (SELECT f.doc_id, f.i, CASE WHEN f.acc > 0 AND (f.acc + n.w) * 1.3::double > 200 THEN n.w ELSE f.acc + n.w END AS nw, CASE WHEN f.acc > 0 AND (f.acc + n.w) * 1.3::double > 200 THEN f.acc ELSE 0 END AS emitted FROM f JOIN n ON n.doc_id = f.doc_id AND n.i = f.i + 1) b
    JOIN n ON n.doc_id = b.doc_id AND n.i = b.i + 1),
  e AS (SELECT doc_id, out_w AS w FROM f WHERE out_w IS NOT NULL UNION ALL SELECT doc_id, before FROM f WHERE before > 0 UNION ALL SELECT doc_id, acc FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) = 1)
  SELECT d.doc_id, count(e.w) FILTER (e.w * 1.3::double >= 20) AS chunks, coalesce(sum(e.w) FILTER (e.w * 1.3::double >= 20), 0)::bigint AS words FROM documents d LEFT JOIN e ON e.doc_id = d.doc_id GROUP BY 1""")
def sentence_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", X.chunks(F.col("text")).alias("c"))
    return rows.select("doc_id", F.size("c").cast("long").alias("chunks"), F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + x["w"]).alias("words"))


@query(f"""WITH t AS (SELECT doc_id, {words_sql("text")} AS ws FROM documents), g AS (SELECT doc_id, unnest({grams_sql("ws", 3)}) AS gram FROM t)
  SELECT gram, count(*) AS n, count(DISTINCT doc_id) AS docs FROM g GROUP BY 1""")
def ngrams(spark: SparkSession, d: str) -> DataFrame:
    """All 1- to 3-grams less stop words, with their number and that of their documents."""
    # a document's texts go to one task; what is shuffled for the count are words with those beside them, not grams
    docs, words = table(spark, d, "documents").select("doc_id", "text"), whole(X.terms(F.col("text"), 1, config.STOP_WORDS))
    size = text_bytes(docs)
    buckets, parts = tasks(docs, TEXT, size), tasks(docs, CHUNK, size)
    small_batches(spark)
    rows = docs.repartition(parts, "doc_id").sortWithinPartitions("doc_id").select("doc_id", words.alias("sections"))
    sent = rows.mapInArrow(G.sent("doc_id", 3, buckets, G.frequent(docs, "doc_id", words, size, buckets), CHUNK), "bucket int, data binary")
    return sent.repartitionById(buckets, "bucket").mapInArrow(G.counts(3), "gram string, n long, docs long")


@query("""SELECT doc_id, CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '...' ELSE text END AS excerpt FROM documents""")
def prompt_context(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.excerpt(F.col("text")).alias("excerpt"))


@query("""WITH o AS (SELECT o_orderkey, date_trunc('month', o_orderdate)::date AS s, date_trunc('month', o_orderdate + to_months((o_orderkey % 30)::int))::date AS e, o_orderkey % 5 = 0 AS open FROM orders),
  m AS (SELECT o_orderkey, CASE WHEN open THEN DATE '2026-01-01' ELSE e END AS e, (year(CASE WHEN open THEN DATE '2026-01-01' ELSE e END) - year(s)) * 12 + month(CASE WHEN open THEN DATE '2026-01-01' ELSE e END) - month(s) + 1 AS n FROM o)
  SELECT o_orderkey, n AS months, round(least(n / 12.0::double, 40), 2) AS years, e AS last_role, round(greatest(0, 1 - date_diff('day', e, DATE '2026-01-01') / 730.0::double), 4) AS recency FROM m""")
def experience_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Ranges written out as in a résumé, read back by the pattern."""
    start, end = F.date_format("o_orderdate", "MMM yyyy"), F.date_format(F.add_months("o_orderdate", (F.col("o_orderkey") % 30).cast("int")), "MMMM yyyy")
    written = F.concat(F.lit("Worked "), start, F.lit(" - "), F.when(F.col("o_orderkey") % 5 == 0, "Present").otherwise(end), F.lit(" at a place"))
    as_of = F.to_date(F.lit("2026-01-01"))
    r = table(spark, d, "orders").select("o_orderkey", D.ranges(written, as_of).alias("r"))
    total = F.aggregate("r", F.lit(0), lambda s, x: s + x["months"])
    out = r.select("o_orderkey", total.cast("long").alias("months"), F.array_max(F.transform("r", lambda x: x["end"])).alias("last_role"))
    return out.select("o_orderkey", "months", F.round(F.least(F.col("months") / 12.0, F.lit(40.0)), 2).alias("years"), "last_role", F.round(D.recency(F.col("last_role"), as_of), 4).alias("recency"))


@query("""WITH r AS (SELECT o_custkey, count(*) AS roles, (date_diff('day', min(o_orderdate)::date, max(o_orderdate)::date)) / 365.0::double AS y FROM orders GROUP BY 1)
  SELECT o_custkey, round(CASE WHEN y <= 0 THEN 0.0 ELSE least(least(y, 20.0) / 10.0, 1.0) END, 4) AS depth, round(1.0 / (1.0 + roles / 5.0), 4)::double AS stability FROM r""")
def experience_signals(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("roles"), (F.datediff(F.max("o_orderdate"), F.min("o_orderdate")) / 365.0).alias("y"))
    return r.select("o_custkey", D.experience_depth(F.col("y")).alias("depth"), D.stability(F.col("roles")).alias("stability"))


_TIER = "p_name || ' ' || (['PhD in rings', 'Master of ' || p_type, 'Bachelor of Arts', 'Diploma', 'no school'])[p_partkey % 5 + 1]"
_HITS = {t: "list_filter([" + ", ".join(f"'{w}'" for w in ws) + "], lambda w: contains(t, w))" for t, ws in config.EDUCATION_TIERS.items()}


@query(f"""SELECT p_partkey, CASE {" ".join(f"WHEN len({h}) > 0 THEN {t}" for t, h in _HITS.items())} ELSE 0 END AS tier,
  CASE {" ".join(f"WHEN len({h}) > 0 THEN array_to_string({h}, '|')" for t, h in _HITS.items())} ELSE '' END AS keywords FROM (SELECT p_partkey, lower({_TIER}) AS t FROM part)""")
def education_tier(spark: SparkSession, d: str) -> DataFrame:
    schools = F.array(F.lit("PhD in rings"), F.concat(F.lit("Master of "), F.col("p_type")), F.lit("Bachelor of Arts"), F.lit("Diploma"), F.lit("no school"))
    written = F.concat(F.col("p_name"), F.lit(" "), F.get(schools, (F.col("p_partkey") % 5).cast("int")))
    rows = table(spark, d, "part").select("p_partkey", X.education_tier(written).alias("e"))
    return rows.select("p_partkey", F.col("e.tier").alias("tier"), F.array_join("e.keywords", "|").alias("keywords"))


_TITLE = "(['Senior Software Engineer', 'data scientist and Tech Lead', 'Full-Stack dev', 'cook', 'Intern, intern'])[p_partkey % 5 + 1] || ' ' || p_name"


@query(f"""SELECT p_partkey, array_to_string(list_sort(list_distinct(regexp_extract_all({_TITLE}, '(?i)\\b({config.JOB_TITLES})\\b'))), '|') AS titles FROM part""")
def title_extract(spark: SparkSession, d: str) -> DataFrame:
    titles = F.array(*map(F.lit, ["Senior Software Engineer", "data scientist and Tech Lead", "Full-Stack dev", "cook", "Intern, intern"]))
    written = F.concat(F.get(titles, (F.col("p_partkey") % 5).cast("int")), F.lit(" "), F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", F.array_join(X.job_titles(written), "|").alias("titles"))


_ORG = "(['Amazon Web Services Inc.', ' Meta ', 'Big  Corp', 'GCP LLC', s_name])[s_suppkey % 5 + 1]"
_ORGS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in config.ORG_NAMES.items()) + "}"
_SKILL = "(['Python 3', 'Node.js', 'java 11', 'C++', 'react  native 0.72'])[s_suppkey % 5 + 1]"
_SKILLS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in config.SKILL_NAMES.items()) + "}"


@query(rf"""SELECT s_suppkey, coalesce({_ORGS}[o][1], regexp_replace(o, '\s+', ' ', 'g')) AS org, coalesce({_SKILLS}[k][1], trim(regexp_replace(regexp_replace(k, '\s*\d+(\.\d+)*$', ''), '\s+', ' ', 'g'))) AS skill
  FROM (SELECT s_suppkey, regexp_replace(trim(lower({_ORG})), '\s+(inc|llc|ltd|corp|corporation|company|co)\.?$', '') AS o, trim(lower({_SKILL})) AS k FROM supplier)""".replace("[o][1]", "[o]").replace("[k][1]", "[k]"))
def entity_normalize(spark: SparkSession, d: str) -> DataFrame:
    i = (F.col("s_suppkey") % 5).cast("int")
    org = F.get(F.array(F.lit("Amazon Web Services Inc."), F.lit(" Meta "), F.lit("Big  Corp"), F.lit("GCP LLC"), F.col("s_name")), i)
    skill = F.get(F.array(*map(F.lit, ["Python 3", "Node.js", "java 11", "C++", "react  native 0.72"])), i)
    return table(spark, d, "supplier").select("s_suppkey", X.normalize_organization(org).alias("org"), X.normalize_skill(skill).alias("skill"))
