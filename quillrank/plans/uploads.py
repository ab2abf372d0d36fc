"""Uploads, reports and indices as they lie in folders, and what a vectoriser has learnt."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank import config
from quillrank.functions import text as X
from quillrank.operators import ranking as R
from quillrank.operators.sections import TermIndex, whole
from quillrank.plans.base import query, table
from quillrank.plans.sql import tfidf_sql
from quillrank.session import scratch_folder
from quillrank.sources import files, sinks

_UPLOADS = r"""u AS (SELECT 0 AS kind, p_partkey AS id, 'cv_' || p_partkey % 50 || (['.txt', '.PDF', '.exe', '.docx'])[p_partkey % 4 + 1] AS name FROM part
  UNION ALL SELECT 1, s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN '._cv.txt' ELSE 'cv_' || s_suppkey % 50 || '_' || (2 + s_suppkey % 5) || '.txt' END FROM supplier),
  r AS (SELECT *, CASE WHEN starts_with(name, '._') THEN 'junk' WHEN ends_with(name, '.exe') THEN 'Unsupported file type .exe' END AS reason FROM u)"""


def _uploads(spark: SparkSession, d: str) -> DataFrame:
    """Single files, and members of archives whose names are numbered already."""
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    ext = F.get(F.array(*map(F.lit, [".txt", ".PDF", ".exe", ".docx"])), (k % 4).cast("int"))
    single = table(spark, d, "part").select(F.lit(0).alias("kind"), k.alias("id"), F.concat(F.lit("cv_"), (k % 50).cast("string"), ext).alias("name"))
    own = F.concat(F.lit("cv_"), (s % 50).cast("string"), F.lit("_"), (2 + s % 5).cast("string"), F.lit(".txt"))
    members = table(spark, d, "supplier").select(F.lit(1).alias("kind"), s.alias("id"), F.when(s % 9 == 0, "._cv.txt").otherwise(own).alias("name"))
    return files.bag(single, members).withColumn("reason", files.skipped(F.col("name")))


@query(f"""WITH {_UPLOADS}, n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY kind, id) AS n, regexp_extract(name, '^(.*)(\\.[^.]*)$', 1) AS stem, regexp_extract(name, '^(.*)(\\.[^.]*)$', 2) AS dot FROM r WHERE reason IS NULL),
  t AS (SELECT list(DISTINCT name) AS names FROM n)
  SELECT kind, id, CASE WHEN n = 1 THEN name ELSE stem || '_' || (list_filter(range(2, n + 20), lambda k: NOT list_contains(names, stem || '_' || k || dot)))[n - 1] || dot END AS saved, reason FROM n, t
  UNION ALL SELECT kind, id, NULL, reason FROM r WHERE reason IS NOT NULL""")
def upload_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of archives and single ones in one list: those taken, each under a name of its own, and why others aren't."""
    rows = _uploads(spark, d)
    taken = files.registered(files.unique_names(rows.where("reason IS NULL"), ["kind", "id"]))
    out = taken.unionByName(rows.where("reason IS NOT NULL").withColumn("name", F.lit(None).cast("string")))
    return out.select("kind", "id", F.col("name").alias("saved"), "reason")


@query(f"WITH {_UPLOADS} SELECT 'exe' AS ext, count(*) AS files FROM r WHERE ends_with(name, '.exe')")
def unsupported_files(spark: SparkSession, d: str) -> DataFrame:
    return files.unsupported(_uploads(spark, d))


_REPORTS = "[" + ", ".join(f"'{n}'" for n in config.REPORT_PATHS) + "]"


@query(f"""WITH w AS (SELECT n_nationkey AS collection, n_name, unnest({_REPORTS}) AS report, unnest(range(0, {len(config.REPORT_PATHS)})) AS i FROM nation), k AS (SELECT *, (collection + i) % 3 AS k FROM w)
  SELECT collection, report, CASE WHEN k = 0 THEN '{{"name":"' || n_name || '"}}' WHEN k = 1 AND report = 'ranking_csv' THEN '{{"name":' END AS content, CASE WHEN k = 2 THEN 'Report not found' WHEN k = 1 AND report <> 'ranking_csv' THEN 'Invalid JSON report' END AS error FROM k""")
def report_files(spark: SparkSession, d: str) -> DataFrame:
    """Every collection's reports: whole, broken or missing ones in turn; a broken CSV file is text all the same."""
    jobs = table(spark, d, "nation").select(F.col("n_nationkey").alias("collection"), "n_name")
    at = F.posexplode(F.array(*map(F.lit, config.REPORT_PATHS.values()))).alias("i", "at")
    text = F.when(F.col("k") == 0, F.concat(F.lit('{"name":"'), F.col("n_name"), F.lit('"}'))).otherwise('{"name":')
    found = jobs.select("collection", "n_name", at).withColumn("k", (F.col("collection") + F.col("i")) % 3).where("k < 2").select(F.concat_ws("/", "collection", "at").alias("path"), text.alias("text"))
    return files.reports(jobs, found)


@query("SELECT event_id, ts::date AS day FROM events ORDER BY ts DESC, event_id LIMIT 100")
def newest_records(spark: SparkSession, d: str) -> DataFrame:
    """The newest hundred records (the limit is the feature)."""
    return files.newest(table(spark, d, "events"), [F.col("ts").desc(), F.col("event_id")], 100).select("event_id", F.to_date("ts").alias("day"))


@query("""SELECT r_regionkey AS company, n_nationkey AS job, row_number() OVER (PARTITION BY r_regionkey ORDER BY last DESC NULLS LAST, n_nationkey) AS place FROM region JOIN nation ON n_regionkey = r_regionkey
  LEFT JOIN (SELECT c_nationkey AS k, max(o_orderdate) AS last FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1) ON k = n_nationkey""")
def jobs_newest_first(spark: SparkSession, d: str) -> DataFrame:
    """A company's jobs by their last change."""
    change = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.max("o_orderdate").alias("last"))
    jobs = table(spark, d, "nation").join(change, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("n_regionkey").alias("company"), F.col("n_nationkey").alias("job"), "last")
    return R.ranked(jobs, [F.col("last").desc_nulls_last(), F.col("job")], ["company"], "place").select("company", "job", "place")


_GOOD = "vec_id % 6 > 1"


@query(f"""WITH m AS (SELECT label AS collection, max(len(embedding)) FILTER ({_GOOD}) AS dimension, count(*) FILTER ({_GOOD}) AS num_vectors, count(*) FILTER (NOT ({_GOOD})) AS skipped FROM embeddings GROUP BY 1)
  SELECT collection, collection % 3 > 0 AS rag_available, num_vectors > 0 AS index_built, CASE WHEN num_vectors > 0 THEN dimension END AS dimension, CASE WHEN num_vectors > 0 THEN num_vectors END AS num_vectors, skipped,
  CASE WHEN num_vectors > 0 THEN 'flat_l2' END AS type FROM m""")
def rag_index(spark: SparkSession, d: str) -> DataFrame:
    """An index a collection is written from the vectors that are there, twice, and its status read back."""
    path, v = scratch_folder(spark), F.col("vec_id")
    vec = F.when(v % 6 == 0, None).when(v % 6 == 1, F.array().cast("array<float>")).otherwise(F.col("embedding"))
    rows = table(spark, d, "embeddings").select(F.col("label").alias("collection"), v, F.format_string("d%d.txt", v).alias("filename"), vec.alias("vec"))
    for _ in range(2):
        sinks.write_index(rows, path, "vec", "collection", "flat_l2", "2026-01-01")
    meta = spark.read.parquet(f"{path}/meta").select("collection", "dimension", "num_vectors", "type")
    kept = spark.read.parquet(f"{path}/vectors").groupBy("collection").agg(F.count("filename").alias("kept"))
    every = rows.groupBy("collection").agg(F.count("*").alias("n")).join(meta, "collection", "left").join(kept, "collection", "left")
    return every.select("collection", (F.col("collection") % 3 > 0).alias("rag_available"), F.coalesce(F.col("kept") > 0, F.lit(False)).alias("index_built"), "dimension", "num_vectors", (F.col("n") - F.coalesce("kept", F.lit(0))).alias("skipped"), "type")


@query(f"""WITH {tfidf_sql(1, '{n}')} SELECT term AS word, count(*) AS df, sum(n)::bigint AS tokens, round(any_value(idf), 6) AS idf, '1' AS ngrams FROM tf JOIN idf USING (term) GROUP BY 1""")
def vectoriser_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """A vectoriser's vocabulary with its words, counts and settings, written and read back."""
    path = scratch_folder(spark)
    index = TermIndex(table(spark, d, "documents"), "doc_id", whole(X.terms(F.col("text"), 1, config.STOP_WORDS)), sublinear=False)
    sinks.write_vectoriser(index, path, {"ngrams": 1, "sublinear": False})
    index.drop()
    read = lambda name: spark.read.parquet(f"{path}/{name}").repartition(index.parts, "term")
    counts = read("doc_terms").groupBy("term").agg(F.sum("n").alias("tokens"), F.count("*").alias("rows"))
    settings = spark.read.schema("settings map<string,string>").json(f"{path}/settings.json").select(F.col("settings")["ngrams"].alias("ngrams"))
    return read("vocabulary").join(counts, "term").crossJoin(settings).select("word", F.col("rows").alias("df"), "tokens", F.round("idf", 6).alias("idf"), "ngrams")


@query("""WITH e AS (SELECT sha256(event_type || user_id) AS key, max(ts) AS made, arg_max(value, (ts, event_id)) AS response FROM events GROUP BY 1), m AS (SELECT max(ts) AS now FROM events)
  SELECT key, response FROM e, m WHERE now - made <= INTERVAL 1 HOUR""")
def response_cache_read(spark: SparkSession, d: str) -> DataFrame:
    """The last answer to each query, if it isn't older than an hour when the last event comes."""
    e = table(spark, d, "events")
    now = e.agg(F.max("ts")).first()[0]
    rows = e.groupBy(F.sha2(F.concat("event_type", F.col("user_id").cast("string")), 256).alias("key")).agg(F.max("ts").alias("made"), F.max_by("value", F.struct("ts", "event_id")).alias("response"))
    return sinks.fresh(rows, "made", F.lit(now))[0].select("key", "response")


_BLOCK = "printf('Candidate %d:' || chr(10) || '- Filename: %s' || chr(10) || '- Rank: %s' || chr(10) || '- Score: %s' || chr(10) || '- Skills: %s' || chr(10) || '- Excerpt: %s', nth, coalesce(name, 'unknown'), coalesce(rank, 'N/A'), '0.5', skills, p_mfgr)"


@query(f"""WITH r AS (SELECT s_nationkey AS job, CASE WHEN ps % 3 > 0 THEN s_name END AS name, CASE WHEN ps % 2 > 0 THEN ps::varchar END AS rank, array_to_string((['a', 'b', 'c', 'd', 'e', 'f'])[1:least(ps % 7, 5)], ', ') AS skills, s_name AS p_mfgr, nth
    FROM (SELECT *, s_suppkey % 11 AS ps, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS nth FROM supplier) WHERE nth <= 3)
  SELECT n_nationkey AS job, CASE WHEN count(nth) > 0 THEN 'Candidates:' || chr(10) || string_agg({_BLOCK}, chr(10) || chr(10) ORDER BY nth) || chr(10) || chr(10) || 'Question: ' || n_name || chr(10) || 'Answer based on the candidates above:' ELSE n_name END AS prompt
  FROM nation LEFT JOIN r ON job = n_nationkey GROUP BY n_nationkey, n_name""")
def prompt_with_skills(spark: SparkSession, d: str) -> DataFrame:
    """A question with the blocks of a job's three best candidates (the limit is the feature) and their first five skills."""
    ps = F.col("s_suppkey") % 11
    skills = F.slice(F.array(*map(F.lit, "abcdef")), 1, (ps % 7).cast("int"))
    c = F.struct(F.col("nth"), F.when(ps % 3 > 0, F.col("s_name")).alias("filename"), F.when(ps % 2 > 0, ps).alias("rank"), F.lit(0.5).alias("score"), skills.alias("skills"), F.col("s_name").alias("excerpt"))
    best = R.ranked(table(spark, d, "supplier"), [F.col("s_acctbal").desc(), F.col("s_suppkey")], ["s_nationkey"], "nth").where("nth <= 3")
    lists = best.groupBy("s_nationkey").agg(F.array_sort(F.collect_list(c)).alias("cs"))
    out = table(spark, d, "nation").join(lists, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return out.select(F.col("n_nationkey").alias("job"), X.user_prompt(F.col("n_name"), F.col("cs")).alias("prompt"))
