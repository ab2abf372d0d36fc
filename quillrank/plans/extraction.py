"""Sections, entities, prompts, incremental runs and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillrank import config
from quillrank.functions import entities as E
from quillrank.functions import sections as S
from quillrank.functions import text as X
from quillrank.operators import ranking as R
from quillrank.operators.sections import TermIndex, boosted
from quillrank.plans import scoring
from quillrank.plans.base import query, table
from quillrank.plans.sql import grams_sql, skills_sql, words_sql
from quillrank.plans.textual import _NORM
from quillrank.session import scratch_folder
from quillrank.sources import files, sinks
from quillrank.streaming import ingest

NOTICES = {"notice": "license|apache", "that": "that "}
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(rf"""WITH p AS (SELECT doc_id, string_split(regexp_replace(text, '(?i)(license|apache|that )', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS ps FROM documents),
  u AS (SELECT doc_id, i, ps[i] AS p FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM p)),
  s AS (SELECT doc_id, i, CASE WHEN i = 1 THEN 'general' WHEN lower(string_split(p, chr(2))[1]) = 'that ' THEN 'that' ELSE 'notice' END AS section, {_STRIP.format("CASE WHEN i = 1 THEN p ELSE string_split(p, chr(2))[2] END")} AS t FROM u)
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, section, sha256(t) AS body FROM s WHERE length(t) > 0""")
def sections_anywhere(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(S.anywhere(F.col("text"), NOTICES)).alias("pos", "s"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("s.section").alias("section"), F.sha2("s.text", 256).alias("body"))


_PAGE = ["'  lead ' || p_name", "'Work Experience at ' || p_brand", "p_type || ' one, two'", "''", "'TECHNICAL SKILLS:'", "p_name || '; sql'", "'Some Other Title'", "'lost ' || p_name", "'Employment'", "'more of ' || p_type || ' x'", "'education'", "p_brand || ' b'"]


@query(f"""WITH l AS (SELECT p_partkey, unnest(list_zip([{", ".join(_PAGE)}], range(12))) AS z FROM part), k AS (SELECT p_partkey, z[2] AS i, z[1] AS line, trim(z[1]) AS t FROM l),
  h AS (SELECT *, CASE WHEN regexp_matches(t, '^(?i:{config.SECTION_LINES["experience"]})') THEN 'experience' WHEN regexp_matches(t, '^(?i:{config.SECTION_LINES["skills"]})') THEN 'skills' WHEN regexp_matches(t, '^(?i:{config.SECTION_LINES["education"]})') THEN 'education'
    WHEN length(t) < 50 AND t <> '' AND ((upper(t) = t AND lower(t) <> t) OR regexp_full_match(t, '[^\\p{{L}}]*\\p{{Lu}}\\p{{Ll}}*([^\\p{{L}}]+\\p{{Lu}}\\p{{Ll}}*)*[^\\p{{L}}]*')) THEN 'lost' END AS kind FROM k),
  g AS (SELECT *, sum((kind IS NOT NULL)::int) OVER (PARTITION BY p_partkey ORDER BY i) AS run FROM h), r AS (SELECT *, coalesce(max(kind) OVER (PARTITION BY p_partkey, run), 'other') AS section FROM g),
  b AS (SELECT p_partkey, section, run, trim(string_agg(line, chr(10) ORDER BY i), ' ' || chr(10)) AS body FROM r WHERE kind IS NULL GROUP BY ALL)
  SELECT p_partkey, section, string_agg(body, chr(10) || chr(10) ORDER BY run) AS body FROM b WHERE section <> 'lost' AND body <> '' GROUP BY 1, 2""")
def sections_lines(spark: SparkSession, d: str) -> DataFrame:
    page = F.concat_ws("\n", *(F.expr(x) for x in _PAGE))
    return table(spark, d, "part").select("p_partkey", F.explode(S.by_lines(page)).alias("section", "body"))


_WROTE = "(['Senior Software Engineer, Ph.D and M. Tech in Computer  Science', 'Bachelor of Science; Lead Data Scientist at Acme', 'MBA, B.A, software engineering', 'no title', 'Big Machine Developer with Master of  Arts in ML'])[p_partkey % 5 + 1] || ' ' || p_name"


def _found(patterns: list[str]) -> str:
    each = ", ".join(f"regexp_extract_all({_WROTE}, '(?i)\\b(?:{p})\\b')" for p in patterns)
    return rf"array_to_string(list_sort(list_distinct(list_transform(flatten([{each}]), lambda x: trim(regexp_replace(replace(lower(x), '.', ''), '\s+', ' ', 'g'))))), '|')"


def _written() -> Column:
    texts = ["Senior Software Engineer, Ph.D and M. Tech in Computer  Science", "Bachelor of Science; Lead Data Scientist at Acme", "MBA, B.A, software engineering", "no title", "Big Machine Developer with Master of  Arts in ML"]
    return F.concat(F.get(F.array(*map(F.lit, texts)), (F.col("p_partkey") % 5).cast("int")), F.lit(" "), F.col("p_name"))


@query(f"SELECT p_partkey, {_found(config.DEGREES)} AS degrees, {_found(config.STUDY_FIELDS)} AS fields FROM part")
def degree_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.array_join(E.degrees(_written()), "|").alias("degrees"), F.array_join(E.study_fields(_written()), "|").alias("fields"))


_ROLES = ", ".join(f"regexp_extract_all({_WROTE}, '\\b(?:{p})\\b')" for p in config.ROLE_PATTERNS)


@query(rf"""SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(flatten([{_ROLES}]), lambda x: lower(regexp_replace(x, '\s+', ' ', 'g'))),
  lambda r: length(r) > 3 AND regexp_matches(r, '{"|".join(config.ROLE_WORDS)}')))), '|') AS roles FROM part""")
def role_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.array_join(E.roles(_written()), "|").alias("roles"))


COMMON = ["the", "license", "mit", "rest", "apache", "the and", "of the"]
_CONTEXT = " + ".join(f"CASE WHEN regexp_matches(lower(text), '{'|'.join(ws)}') THEN {w} ELSE 0 END" for ws, w in config.CONTEXTS.values())


@query(f"""WITH n AS (SELECT doc_id, text, {_NORM} AS n FROM documents), c AS (SELECT doc_id, ({_CONTEXT})::double AS cw, v AS skill, CASE WHEN contains(v, ' ') THEN (length(n) - length(replace(n, v, ''))) // length(v)
    ELSE len(list_filter(string_split(n, ' '), lambda w: w = v)) END AS mentions FROM n, unnest({COMMON}) AS t(v))
  SELECT doc_id, skill, mentions, round(mentions / (sum(mentions) OVER (PARTITION BY doc_id))::double * CASE WHEN cw > 0 THEN cw ELSE 0.1 END, 4) AS confidence FROM c WHERE mentions > 0""")
def skill_confidence(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.explode(E.skill_mentions(F.col("text"), COMMON)).alias("s"))
    return rows.select("doc_id", F.col("s.skill").alias("skill"), F.col("s.count").alias("mentions"), F.col("s.confidence").alias("confidence"))


#: Sections of the documents as they are: what comes before any of these words is general.
PARTS = {"experience": "license|apache", "skills": "that ", "projects": "with "}
_KIND = "CASE WHEN i = 1 THEN 'general' " + " ".join(f"WHEN regexp_full_match(lower(string_split(p, chr(2))[1]), '{w}') THEN '{k}'" for k, w in PARTS.items()) + " END"


@query(rf"""WITH p AS (SELECT doc_id, string_split(regexp_replace(text, '(?i)({"|".join(PARTS.values())})', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS ps FROM documents),
  u AS (SELECT doc_id, i, ps[i] AS p FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM p)),
  z AS (SELECT doc_id, {_KIND} AS section, CASE WHEN i = 1 THEN p ELSE string_split(p, chr(2))[2] END AS t FROM u), x AS (SELECT doc_id, section, {words_sql("t")} AS ws FROM z),
  t AS (SELECT doc_id, section, unnest({grams_sql("ws", 3)}) AS term FROM x), tf AS (SELECT doc_id, section, term, count(*) AS n FROM t GROUP BY ALL),
  sw AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {w}::double)" for k, w in config.SECTION_WEIGHTS.items())}) v(section, sw)),
  f AS (SELECT section, any_value(sw) AS sw, count(DISTINCT doc_id) AS docs FROM tf JOIN sw USING (section) GROUP BY 1),
  idf AS (SELECT section, term, ln((1 + any_value(docs)) / (1 + count(*))::double) + 1 AS idf FROM tf JOIN f USING (section) GROUP BY ALL HAVING count(*) >= 2),
  jw AS (SELECT item_id, {words_sql("text")} AS ws FROM benchmark), jt AS (SELECT item_id, term, count(*) AS n FROM (SELECT item_id, unnest({grams_sql("ws", 3)}) AS term FROM jw) GROUP BY 1, 2),
  q AS (SELECT item_id, section, term, (1 + ln(n)) * idf AS q FROM jt JOIN idf USING (term)), qn AS (SELECT item_id, section, sqrt(sum(q * q)) AS qn FROM q GROUP BY 1, 2),
  dn AS (SELECT doc_id, section, sqrt(sum(((1 + ln(n)) * idf) ** 2)) AS dn FROM tf JOIN idf USING (section, term) GROUP BY 1, 2),
  c AS (SELECT item_id, doc_id, section, sum((1 + ln(n)) * idf * q) / (any_value(dn) * any_value(qn)) AS cos FROM tf JOIN idf USING (section, term) JOIN q USING (section, term) JOIN dn USING (doc_id, section) JOIN qn USING (item_id, section) GROUP BY 1, 2, 3),
  s AS (SELECT item_id, doc_id, sum(sw * cos) / (SELECT sum(sw) FROM f) AS s FROM c JOIN f USING (section) GROUP BY 1, 2),
  js AS (SELECT item_id, {skills_sql("text", scoring.VOCABULARY)} AS want FROM benchmark), ds AS (SELECT doc_id, {skills_sql("text", scoring.VOCABULARY)} AS own FROM documents)
  SELECT item_id, doc_id, round(least(s * (1 + 0.5 * CASE WHEN len(want) > 0 THEN len(list_intersect(want, own)) / len(want)::double ELSE 0 END), 1), 6)::double AS score FROM s JOIN js USING (item_id) JOIN ds USING (doc_id)""")
def section_tfidf_boost(spark: SparkSession, d: str) -> DataFrame:
    """Sections of whole texts, 1- to 3-grams less stop words in at least two documents, boosted by the share of the
    description's skills that a document has: all descriptions and documents that share a term."""
    docs, wanted = table(spark, d, "documents").select("doc_id", "text"), scoring.asked(spark, d, 3)
    cut = F.transform(S.anywhere(F.col("text"), PARTS), lambda s: F.struct(s["section"].alias("section"), X.terms(s["text"], 1, config.STOP_WORDS).alias("terms")))
    index = TermIndex(docs, "doc_id", cut, min_df=2, n=3)
    own = docs.select("doc_id", X.extract_skills(F.col("text"), scoring.VOCABULARY).alias("own"))
    near = index.similarities(wanted, config.SECTION_WEIGHTS).join(own, "doc_id").join(wanted.select("item", "skills"), "item")
    return near.select(F.col("item").alias("item_id"), "doc_id", F.round(boosted(F.col("similarity"), R.overlap(F.col("skills"), F.col("own"))), 6).alias("score"))


@query(f"""WITH {scoring._JOB}, m AS (SELECT x.*, own, list_filter(w, lambda e: NOT list_contains(own, e)) AS missing, len(list_intersect(w, own)) AS hit FROM x JOIN own ON s = candidate, want),
  y AS (SELECT *, least(1.0, (hit + 0.6 * len(list_filter(missing, lambda e: len(list_intersect(coalesce(MAP {{'cloud': ['ring', 'bolt'], 'widget': ['gear'], 'red': []}}[e], []), own)) > 0))) / 4.0::double) AS sk FROM m)
  SELECT job, candidate, round(sk, 4)::double AS skill, round(0.45 * semantic + 0.3 * sk + 0.15 * experience + 0.1 * education, 4)::double AS final,
  row_number() OVER (PARTITION BY job ORDER BY round(0.45 * semantic + 0.3 * sk + 0.15 * experience + 0.1 * education, 4) DESC, candidate) AS rank_position FROM y""")
def job_rank_contextual(spark: SparkSession, d: str) -> DataFrame:
    """As the keyword ranking, but skills that others imply count in part."""
    implied = F.create_map(*(x for k, v in scoring.IMPLIED.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))))
    own = scoring._own(spark, d).withColumn("cov", R.covered(F.array_except(scoring._wanted(), F.col("own")), F.col("own"), implied))
    skill = own.select("s", R.contextual(scoring._wanted(), F.col("own"), F.col("cov")).alias("skill"))
    rows = scoring._features(spark, d).drop("skill").join(skill, F.col("candidate") == F.col("s")).drop("s")
    return R.scored(rows, config.RankingConfig(), "candidate").select("job", "candidate", "skill", "final", "rank_position")


@query("""SELECT sha256(text) AS h, min(doc_id) AS first_id, count(*) - 1 AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1""")
def duplicate_report(spark: SparkSession, d: str) -> DataFrame:
    groups = table(spark, d, "documents").where("text IS NOT NULL").groupBy(F.sha2("text", 256).alias("h"))
    return groups.agg(F.min("doc_id").alias("first_id"), (F.count("*") - 1).alias("copies")).where("copies > 0")


@query("""SELECT event_id, (props::json->>'k')::bigint AS k, '{"k":' || (props::json->>'k') || '}' AS again FROM events""")
def json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    parsed = F.from_json("props", "k long")
    return table(spark, d, "events").select("event_id", parsed["k"].alias("k"), F.to_json(parsed).alias("again"))


@query("""WITH r AS (SELECT n_nationkey, n_name, s_name, s_acctbal, row_number() OVER (PARTITION BY n_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM nation JOIN supplier ON s_nationkey = n_nationkey)
  SELECT n_nationkey AS job, 'Candidates:' || chr(10) || string_agg('Candidate ' || rank || ':' || chr(10) || '- Filename: ' || s_name || chr(10) || '- Rank: ' || rank, chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Question: ' || n_name || '?' AS prompt FROM r WHERE rank <= 3 GROUP BY n_nationkey, n_name""")
def prompt_assembly(spark: SparkSession, d: str) -> DataFrame:
    """A numbered block for each of a job's three best candidates (the limit is the feature), then the question."""
    w = Window.partitionBy("n_nationkey").orderBy(F.col("s_acctbal").desc(), "s_suppkey")
    best = table(spark, d, "nation").join(table(spark, d, "supplier"), F.col("s_nationkey") == F.col("n_nationkey")).withColumn("rank", F.row_number().over(w)).where("rank <= 3")
    block = F.format_string("Candidate %d:\n- Filename: %s\n- Rank: %d", "rank", "s_name", "rank")
    blocks = best.groupBy("n_nationkey", "n_name").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("bs"))
    text = F.array_join(F.transform("bs", lambda x: x["b"]), "\n\n")
    return blocks.select(F.col("n_nationkey").alias("job"), F.concat(F.lit("Candidates:\n"), text, F.lit("\n\nQuestion: "), F.col("n_name"), F.lit("?")).alias("prompt"))


@query("SELECT label AS candidate, max(len(embedding)) AS dimension, count(*) AS num_vectors FROM embeddings GROUP BY 1")
def vector_index_meta(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").groupBy(F.col("label").alias("candidate")).agg(F.max(F.size("embedding")).cast("long").alias("dimension"), F.count("embedding").alias("num_vectors"))


@query("""SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS latest FROM orders GROUP BY 1""")
def index_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Odd orders loaded over even ones: each customer keeps the row of the latest version."""
    rows = table(spark, d, "orders").select("o_custkey", "o_totalprice", F.struct("o_orderdate", "o_orderkey").alias("version"))
    odd = F.col("version.o_orderkey") % 2 == 1
    return sinks.upserted(rows.where(~odd), rows.where(odd), ["o_custkey"], "version").select("o_custkey", F.col("o_totalprice").alias("latest"))


@query("SELECT DISTINCT sha256(text) AS h FROM documents WHERE text IS NOT NULL")
def incremental_ingest(spark: SparkSession, d: str) -> DataFrame:
    """First-seen texts of a stream of files, in a run that takes all that is there."""
    root = scratch_folder(spark)
    rows = ingest.stream(spark, f"{d}/documents.parquet", "doc_id long, text string").where("text IS NOT NULL")
    ingest.run_once(ingest.first_seen(rows).select("h"), f"{root}/out", f"{root}/state")
    return spark.read.schema("h string").parquet(f"{root}/out").select("h")


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def replaced_rankings(spark: SparkSession, d: str) -> DataFrame:
    """A table by status is written with wrong prices, then each status is replaced whole."""
    path, rows = scratch_folder(spark), table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    sinks.replace_partitions(rows.withColumn("o_totalprice", F.lit(0.0)), path, "o_orderstatus")
    sinks.replace_partitions(rows, path, "o_orderstatus")
    return spark.read.schema(rows.schema).parquet(path)


@query("""SELECT '.' || regexp_extract(url, '^[a-z]+', 0) || '.txt' AS ext, count(*) AS n FROM pages GROUP BY 1""")
def file_names(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("."), F.regexp_extract("url", "^[a-z]+", 0), F.lit(".txt"))
    return table(spark, d, "pages").where(files.accepted(name)).groupBy(name.alias("ext")).agg(F.count("*").alias("n"))
