"""Reports, lists and small records: what is assembled from parts that may be missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillrank.functions import text as X
from quillrank.operators import records as M
from quillrank.operators.ranking import ranked
from quillrank.plans.base import query, table
from quillrank.session import scratch_folder
from quillrank.sources import sinks


@query("""WITH v AS (SELECT n_regionkey AS k, count(*) AS files FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey <> 1 GROUP BY 1), u AS (SELECT n_regionkey AS k, count(*) AS copies FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal > 5000 GROUP BY 1),
  r AS (SELECT n_regionkey AS k, round(max(o_totalprice), 2) AS best, count(*) AS ranked FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE n_regionkey <> 2 GROUP BY 1)
  SELECT r_regionkey AS collection, r_name AS meta, files AS validation, copies AS duplicates, best AS ranking_best, CASE WHEN r_regionkey % 2 = 0 THEN ranked END AS results FROM region LEFT JOIN v ON v.k = r_regionkey LEFT JOIN u ON u.k = r_regionkey LEFT JOIN r ON r.k = r_regionkey""")
def collection_report(spark: SparkSession, d: str) -> DataFrame:
    """One row a collection: its meta data and its parts' reports, null where one is missing; results only where asked."""
    jobs = table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("k"))
    people = jobs.join(table(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"))
    validation = people.where("k != 1").groupBy("k").agg(F.count("*").alias("validation"))
    copies = jobs.join(table(spark, d, "supplier").where("s_acctbal > 5000"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("k").agg(F.count("*").alias("duplicates"))
    ranking = people.where("k != 2").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey")).groupBy("k").agg(F.round(F.max("o_totalprice"), 2).alias("ranking_best"), F.count("*").alias("ranked"))
    out = table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("meta"))
    for part in (validation, copies, ranking):
        out = out.join(part, "k", "left")
    return out.select(F.col("k").alias("collection"), "meta", "validation", "duplicates", "ranking_best", F.when(F.col("k") % 2 == 0, F.col("ranked")).alias("results"))


@query("""WITH e AS (SELECT 'Supplier#' || s_suppkey || '.v1' AS base, s_acctbal AS entities FROM supplier WHERE s_suppkey % 3 > 0), n AS (SELECT s_suppkey, 'Supplier#' || s_suppkey || (['.v1.txt', '.v1', '.v1.pdf', '.v1.pdf.txt'])[s_suppkey % 4 + 1] AS name FROM supplier)
  SELECT name, entities FROM n LEFT JOIN e ON base = regexp_replace(regexp_replace(name, '\\.txt$', ''), '\\.pdf$', '')""")
def entities_by_filename(spark: SparkSession, d: str) -> DataFrame:
    rows, key = table(spark, d, "supplier"), F.concat(F.lit("Supplier#"), F.col("s_suppkey").cast("string"))
    kept = rows.where("s_suppkey % 3 > 0").select(F.concat(key, F.lit(".v1")).alias("base"), F.col("s_acctbal").alias("entities"))
    suffix = F.get(F.array(*map(F.lit, [".v1.txt", ".v1", ".v1.pdf", ".v1.pdf.txt"])), (F.col("s_suppkey") % 4).cast("int"))
    return M.by_file(kept, rows.select(F.concat(key, suffix).alias("name")))


@query("""SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders QUALIFY place <= 10""")
def recent_items(spark: SparkSession, d: str) -> DataFrame:
    """Each owner's last ten, newest first."""
    by = [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]
    rows = M.latest(table(spark, d, "orders"), ["o_custkey"], by, 10)
    return rows.select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(*by)).cast("long").alias("place"))


@query("""SELECT c_name AS candidate, c_acctbal AS score FROM customer WHERE c_name IN ('Customer#000000001', 'Customer#000000007', 'Customer#000000042')""")
def comparison_selection(spark: SparkSession, d: str) -> DataFrame:
    """The candidates chosen for a comparison (three names at most are the feature)."""
    chosen = ["Customer#000000001", "Customer#000000007", "Customer#000000042"]
    return table(spark, d, "customer").where(F.col("c_name").isin(chosen)).select(F.col("c_name").alias("candidate"), F.col("c_acctbal").alias("score"))


@query("""SELECT o_orderstatus AS job, round(coalesce(avg(o_totalprice), 0), 2) AS average, max(o_totalprice) AS best, sum(o_orderkey % 4)::bigint AS inferred, count(*) FILTER (o_orderkey % 4 > 0) AS with_inferred,
  max(printf('%.2f%%', (o_orderkey % 7)::double / 8 * 100)) AS shown FROM orders GROUP BY 1""")
def ui_summary(spark: SparkSession, d: str) -> DataFrame:
    """Average and best score, inferred skills, and candidates with any."""
    n = F.col("o_orderkey") % 4
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("job")).agg(
        F.round(F.coalesce(F.avg("o_totalprice"), F.lit(0.0)), 2).alias("average"), F.max("o_totalprice").alias("best"), F.sum(n).alias("inferred"), F.count_if(n > 0).alias("with_inferred"), F.max(X.percent(F.col("o_orderkey") % 7 / 8)).alias("shown"),
    )


@query("""SELECT o_orderkey AS candidate, CASE WHEN o_orderkey % 5 = 0 THEN 1.0 ELSE o_totalprice END AS final, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 9 ELSE 0 END AS place FROM orders""")
def rerank_merge(spark: SparkSession, d: str) -> DataFrame:
    """New scores and places over old rows; rows that the new ranking lacks keep theirs."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("candidate"), F.col("o_totalprice").alias("final"), F.lit(0).cast("long").alias("place"))
    new = rows.where("candidate % 5 = 0").select("candidate", F.lit(1.0).alias("final"), (F.col("candidate") % 9).alias("place"))
    return M.corrected(rows, new, ["candidate"], ["final", "place"])


@query("""SELECT n_nationkey AS job, n_name AS title, (n_nationkey % 4 > 0) AND count(c_custkey) FILTER (c_acctbal > 0) > 0 AS indexed, count(o.k) > 0 AS ranked FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON o.k = c_custkey WHERE n_regionkey = 2 AND n_name <> 'NATION_7' GROUP BY 1, 2""")
def readiness_gates(spark: SparkSession, d: str) -> DataFrame:
    """One company's jobs that aren't deleted: whether processing is complete and an index there, and whether they are
    ranked."""
    jobs = M.guarded(table(spark, d, "nation").withColumn("state", F.when(F.col("n_name") == "NATION_7", "deleted").otherwise("open")), "n_regionkey", 2, "state")
    ranked = table(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct()
    people = table(spark, d, "customer").join(ranked, F.col("c_custkey") == F.col("k"), "left").groupBy("c_nationkey").agg(F.count_if(F.col("c_acctbal") > 0).alias("n"), F.count("k").alias("r"))
    out = jobs.join(people, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    some = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    return out.select(F.col("n_nationkey").alias("job"), F.col("n_name").alias("title"), ((F.col("n_nationkey") % 4 > 0) & some("n")).alias("indexed"), some("r").alias("ranked"))


@query("""SELECT n_nationkey AS job, o_orderkey AS ranking, row_number() OVER (PARTITION BY n_nationkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, count(*) OVER (PARTITION BY n_nationkey) AS total
  FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE n_regionkey = 1 AND o_totalprice >= 200000 AND o_orderstatus = 'F' QUALIFY rank <= 20""")
def rankings_by_job(spark: SparkSession, d: str) -> DataFrame:
    """The first page of each of a company's jobs, with the number of rows that the filters leave (the page is the
    feature)."""
    jobs = M.guarded(table(spark, d, "nation"), "n_regionkey", 1).select(F.col("n_nationkey").alias("job"))
    rows = table(spark, d, "orders").where("o_totalprice >= 200000 AND o_orderstatus = 'F'").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(jobs, F.col("c_nationkey") == F.col("job")).select("job", F.col("o_orderkey").alias("ranking"), "o_totalprice")
    totals = rows.groupBy("job").agg(F.count("*").alias("total"))
    page = ranked(rows, [F.col("o_totalprice").desc(), F.col("ranking")], ["job"]).where("rank <= 20")
    return page.join(totals, "job").select("job", "ranking", "rank", "total")


_ANSWER = """(['```json\n{"SQL ": [" Postgres", "", "MySQL"], "x": 1, " ": ["a"]}\n```', 'Sure: {"Cloud": ["AWS"], "cloud": ["GCP ", "gcp"]} done', 'no object', '{"broken": [', NULL])[p_partkey % 5 + 1]"""
_MAP = """(['sql=postgres|mysql', 'cloud=gcp|gcp', NULL, NULL, NULL])[p_partkey % 5 + 1]"""


@query(f"""SELECT p_partkey, (['ready', 'ready', 'failed', 'failed', 'pending'])[p_partkey % 5 + 1] AS status, {_MAP} AS implied, (CASE p_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 1 ELSE 0 END) AS skill_count,
  (CASE p_partkey % 5 WHEN 0 THEN 2 WHEN 1 THEN 2 ELSE 0 END) AS implied_skills_total, len(string_split(p_name, ' ')) AS jd_word_count FROM part""")
def skill_map_build(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a model as maps, their status and counts."""
    answers = F.array(F.lit('```json\n{"SQL ": [" Postgres", "", "MySQL"], "x": 1, " ": ["a"]}\n```'), F.lit('Sure: {"Cloud": ["AWS"], "cloud": ["GCP ", "gcp"]} done'), F.lit("no object"), F.lit('{"broken": ['), F.lit(None).cast("string"))
    answer = F.get(answers, (F.col("p_partkey") % 5).cast("int"))
    rows = table(spark, d, "part").select("p_partkey", M.map_status(answer).alias("status"), M.implied_map(answer).alias("m"), "p_name")
    ready = M.ready_map(F.col("status"), F.col("m"))
    meta = M.map_meta(ready, F.col("p_name"))
    flat = F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "|"))), ";")
    return rows.select("p_partkey", "status", flat.alias("implied"), meta["skill_count"].alias("skill_count"), meta["implied_skills_total"].alias("implied_skills_total"), meta["jd_word_count"].alias("jd_word_count"))


@query("""SELECT s_suppkey, (['a,b', 'c', 'd', '', ''])[s_suppkey % 5 + 1] AS skills, CASE WHEN s_suppkey % 2 = 0 THEN 'new' ELSE 'old' END AS theme, 'en' AS lang FROM supplier""")
def settings_and_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    files = F.array(*map(F.lit, ['["a", "b"]', '{"skills": ["c"], "canonical_skills": ["x"]}', '{"canonical_skills": ["d"]}', '{"other": 1}', "3"]))
    old = F.create_map(F.lit("theme"), F.lit("old"), F.lit("lang"), F.lit("en"))
    new = F.when(F.col("s_suppkey") % 2 == 0, F.create_map(F.lit("theme"), F.lit("new"))).otherwise(F.create_map().cast("map<string,string>"))
    both = M.updated(old, new)
    return table(spark, d, "supplier").select("s_suppkey", F.array_join(M.taxonomy(F.get(files, (F.col("s_suppkey") % 5).cast("int"))), ",").alias("skills"), both["theme"].alias("theme"), both["lang"].alias("lang"))


@query("""SELECT p_partkey AS job, CASE WHEN p_partkey % 3 = 0 THEN 'text of ' || p_name WHEN p_partkey % 3 = 1 THEN 'pdf of ' || p_name ELSE 'docx of ' || p_name END AS text FROM part WHERE p_partkey % 4 > 0""")
def description_by_priority(spark: SparkSession, d: str) -> DataFrame:
    """A description from its text file, else its PDF, else its DOCX; blank ones don't count."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    kinds = {"txt": F.when(k % 3 == 0, F.concat(F.lit("text of "), F.col("p_name"))).otherwise(" \n"), "pdf": F.when(k % 3 < 2, F.concat(F.lit(" pdf of "), F.col("p_name"))), "docx": F.concat(F.lit("docx of "), F.col("p_name"), F.lit("\n"))}
    rows = p.where("p_partkey % 4 > 0").select(k.alias("job"), F.inline(F.array(*(F.struct(F.lit(n).alias("kind"), t.alias("text")) for n, t in kinds.items()))))
    empty = p.where("p_partkey % 4 = 0").select(k.alias("job"), F.lit("txt").alias("kind"), F.lit("  ").alias("text"))
    return M.first_text(rows.unionByName(empty), "job", "kind", ["txt", "pdf", "docx"])


@query(r"""SELECT p_partkey, trim(replace(replace(replace(' ../' || p_name || '\' || p_brand || '..txt ', '/', '_'), '\', '_'), '..', '_')) AS safe,
  (['Unsupported format: .exe (supported: .pdf, .docx, .txt)', 'Extraction error: Failed to extract text: x', 'Processing timeout: OCR TimeOut', 'Processing failed: boom'])[p_partkey % 4 + 1] AS reason FROM part""")
def names_and_failures(spark: SparkSession, d: str) -> DataFrame:
    errors = F.array(*map(F.lit, ["Unsupported file type .exe", "Failed to extract text: x", "OCR TimeOut", "boom"]))
    name = F.concat(F.lit(" ../"), F.col("p_name"), F.lit("\\"), F.col("p_brand"), F.lit("..txt "))
    return table(spark, d, "part").select("p_partkey", X.sanitize_filename(name).alias("safe"), X.failure(F.lit(".exe"), F.get(errors, (F.col("p_partkey") % 4).cast("int"))).alias("reason"))


@query("""SELECT sha256(event_type || user_id) AS key, max(ts)::date AS day, arg_max(value, (ts, event_id)) AS response FROM events GROUP BY 1""")
def response_cache(spark: SparkSession, d: str) -> DataFrame:
    """Answers by the hash of their query: a later one takes the place of an earlier one."""
    rows = table(spark, d, "events").select(F.sha2(F.concat("event_type", F.col("user_id").cast("string")), 256).alias("key"), F.col("value").alias("response"), F.struct("ts", "event_id").alias("version"))
    late = F.col("version.event_id") % 2 == 1
    return sinks.upserted(rows.where(~late), rows.where(late), ["key"], "version").select("key", F.to_date("version.ts").alias("day"), "response")


@query("""SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 10 > 0""")
def delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Candidates are deleted, and with them what hangs on them."""
    people = table(spark, d, "customer")
    gone = people.where("c_custkey % 10 = 0").select("c_custkey")
    left, rankings = sinks.without_cascade(people, {"rankings": (table(spark, d, "orders"), "o_custkey")}, gone, "c_custkey")
    return left.join(rankings["rankings"], F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "o_orderkey")


@query("""WITH r AS (SELECT o_orderkey AS candidate, o_orderstatus AS job, CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END AS final FROM orders)
  SELECT candidate, job, final, row_number() OVER (PARTITION BY job ORDER BY final DESC, candidate) AS rank, row_number() OVER (PARTITION BY job ORDER BY final DESC, candidate) AS csv_rank, count(*) OVER (PARTITION BY job) AS candidates,
    CASE WHEN job = 'F' THEN 'contextual' ELSE 'keyword' END AS mode, CASE WHEN job = 'F' THEN DATE '2026-01-02' ELSE DATE '2026-01-01' END AS ranked_at, CASE WHEN job = 'F' THEN 0.25 ELSE 0.45 END::double AS semantic_weight FROM r""")
def rankings_written(spark: SparkSession, d: str) -> DataFrame:
    """Rankings of all jobs as JSON, CSV and summaries, then one job's anew; all three read back."""
    path = scratch_folder(spark)
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("candidate"), F.col("o_orderstatus").alias("job"), F.col("o_totalprice").alias("final"))
    by = [F.col("final").desc(), F.col("candidate")]
    sinks.write_ranking(rows, path, "job", by, ["candidate", "final"], "keyword", "2026-01-01", {"semantic": 0.45})
    sinks.write_ranking(rows.where("job = 'F'").withColumn("final", -F.col("final")), path, "job", by, ["candidate", "final"], "contextual", "2026-01-02", {"semantic": 0.25})
    found = spark.read.schema("candidate long, job string, final double, rank long, mode string, ranked_at date, weights map<string,double>").json(f"{path}/ranking.json")
    lines = spark.read.schema("rank long, candidate long, final double, job string").option("header", "true").csv(f"{path}/ranking.csv")
    sums = spark.read.schema("job string, candidates long").json(f"{path}/summary.json")
    both = found.join(lines.select("candidate", F.col("rank").alias("csv_rank")), "candidate").join(sums, "job")
    return both.select("candidate", "job", "final", "rank", "csv_rank", "candidates", "mode", "ranked_at", F.col("weights")["semantic"].alias("semantic_weight"))
