"""Counts, joins, pages and reports over the relational tables.

Roles: region as company, nation as job, customer as candidate, orders as ranking rows, events as latency samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillrank import config
from quillrank.config import RankingConfig
from quillrank.functions import text as X
from quillrank.operators import ranking as R
from quillrank.operators import records as M
from quillrank.plans.base import query, table

count_if = F.count_if


@query("""SELECT count(*) FILTER (o_orderstatus = 'O') AS uploaded, count(*) FILTER (o_orderstatus = 'P') AS processing,
  count(*) FILTER (o_orderstatus = 'F') AS processed, count(*) FILTER (o_orderstatus NOT IN ('O','P','F')) AS failed, count(*) AS total,
  count(*) FILTER (o_orderstatus IN ('O','P')) = 0 AS indexing_complete FROM orders""")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").agg(
        count_if(s == "O").alias("uploaded"), count_if(s == "P").alias("processing"), count_if(s == "F").alias("processed"),
        count_if(~s.isin("O", "P", "F")).alias("failed"), F.count("*").alias("total"), (count_if(s.isin("O", "P")) == 0).alias("indexing_complete"),
    )


@query("""WITH c AS (SELECT c_nationkey AS k, count(*) AS resumes FROM customer GROUP BY 1),
  i AS (SELECT c_nationkey AS k, count(*) AS indexed FROM customer WHERE c_acctbal > 0 GROUP BY 1),
  r AS (SELECT c_nationkey AS k, max(o_totalprice) AS top_score, max(o_orderdate)::date AS last_ranked, count(*) AS ranked FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
  SELECT n_nationkey AS job, n_name AS title, coalesce(resumes, 0) AS resumes, coalesce(indexed, 0) AS indexed, coalesce(ranked, 0) AS ranked, top_score, last_ranked,
  CASE WHEN coalesce(ranked, 0) > 0 THEN 'ranked' WHEN coalesce(indexed, 0) > 0 THEN 'indexed' ELSE 'uploaded' END AS stage
  FROM nation LEFT JOIN c ON c.k = n_nationkey LEFT JOIN i ON i.k = n_nationkey LEFT JOIN r ON r.k = n_nationkey""")
def job_stats_join(spark: SparkSession, d: str) -> DataFrame:
    jobs, people, rankings = (table(spark, d, t) for t in ("nation", "customer", "orders"))
    counts = people.groupBy("c_nationkey").agg(F.count("*").alias("resumes"), count_if(F.col("c_acctbal") > 0).alias("indexed"))
    best = rankings.join(people, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("k")).agg(F.max("o_totalprice").alias("top_score"), F.to_date(F.max("o_orderdate")).alias("last_ranked"), F.count("*").alias("ranked"))
    out = jobs.join(counts, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(best, F.col("n_nationkey") == F.col("k"), "left").fillna(0, ["resumes", "indexed", "ranked"])
    stage = F.when(F.col("ranked") > 0, "ranked").when(F.col("indexed") > 0, "indexed").otherwise("uploaded")
    return out.select(F.col("n_nationkey").alias("job"), F.col("n_name").alias("title"), "resumes", "indexed", "ranked", "top_score", "last_ranked", stage.alias("stage"))


@query("""SELECT r_regionkey AS company, count(DISTINCT n_nationkey) AS jobs, count(DISTINCT CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END) AS open_jobs,
  count(DISTINCT c_custkey) AS candidates, count(DISTINCT CASE WHEN c_acctbal > 0 THEN c_custkey END) AS indexed, count(DISTINCT o_custkey) AS ranked
  FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def dashboard_summary(spark: SparkSession, d: str) -> DataFrame:
    ranked = table(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct().withColumn("ranked", F.lit(1))
    people = table(spark, d, "customer").join(ranked, F.col("c_custkey") == F.col("k"), "left")
    per_job = people.groupBy("c_nationkey").agg(F.count("*").alias("candidates"), count_if(F.col("c_acctbal") > 0).alias("indexed"), F.count("ranked").alias("ranked"))
    jobs = table(spark, d, "nation").join(per_job, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    sums = jobs.groupBy("n_regionkey").agg(F.count("*").alias("jobs"), count_if(F.col("n_nationkey") % 2 == 0).alias("open_jobs"), *(F.sum(c).alias(c) for c in ("candidates", "indexed", "ranked")))
    out = table(spark, d, "region").join(sums, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return out.fillna(0).select(F.col("r_regionkey").alias("company"), "jobs", "open_jobs", "candidates", "indexed", "ranked")


@query("""SELECT o_orderkey AS ranking, c_name AS candidate, o_totalprice AS final_score, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice >= 100000 AND o_orderstatus <> 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 20""")
def rankings_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of rankings: the limit is the feature; ranks follow from the page's offset, so that nothing is sorted whole."""
    rows = table(spark, d, "orders").where((F.col("o_totalprice") >= 100000) & (F.col("o_orderstatus") != "P"))
    page = rows.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(70)
    w = Window.orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return page.withColumn("rank", F.row_number().over(w).cast("long")).where("rank > 20").select(F.col("o_orderkey").alias("ranking"), F.col("c_name").alias("candidate"), F.col("o_totalprice").alias("final_score"), "rank")


@query("""SELECT c_custkey AS candidate, c_name AS name, i.balance, o.k IS NOT NULL AS ranked FROM customer
  LEFT JOIN (SELECT c_custkey AS ik, c_acctbal AS balance FROM customer WHERE c_acctbal > 0) i ON i.ik = c_custkey LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON o.k = c_custkey""")
def candidate_list(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "customer")
    index = people.where("c_acctbal > 0").select(F.col("c_custkey").alias("ik"), F.col("c_acctbal").alias("balance"))
    ranked = table(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct()
    out = people.join(index, F.col("c_custkey") == F.col("ik"), "left").join(ranked, F.col("c_custkey") == F.col("k"), "left")
    return out.select(F.col("c_custkey").alias("candidate"), F.col("c_name").alias("name"), "balance", F.col("k").isNotNull().alias("ranked"))


@query("""SELECT c_custkey AS candidate, n_nationkey AS job, i.balance, o.k IS NOT NULL AS ranked FROM customer JOIN nation ON n_nationkey = c_nationkey
  LEFT JOIN (SELECT c_custkey AS ik, c_acctbal AS balance FROM customer WHERE c_acctbal > 0) i ON i.ik = c_custkey LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON o.k = c_custkey WHERE n_regionkey = 1""")
def company_candidates(spark: SparkSession, d: str) -> DataFrame:
    """One company's candidates, through its jobs: those of others are not seen."""
    jobs = M.guarded(table(spark, d, "nation"), "n_regionkey", 1).select(F.col("n_nationkey").alias("job"))
    own = table(spark, d, "customer").join(jobs, F.col("c_nationkey") == F.col("job"))
    ranked = table(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct()
    out = own.join(ranked, F.col("c_custkey") == F.col("k"), "left")
    return out.select(F.col("c_custkey").alias("candidate"), "job", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"), F.col("k").isNotNull().alias("ranked"))


@query("""SELECT n_nationkey AS job, count(*) FILTER (o_orderstatus = 'O') AS uploaded, count(*) FILTER (o_orderstatus = 'P') AS processing, count(*) FILTER (o_orderstatus = 'F') AS processed, count(o_orderkey) AS total,
  count(*) FILTER (o_orderstatus IN ('O', 'P')) = 0 AS indexing_complete FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey WHERE n_regionkey = 3 GROUP BY 1""")
def company_statuses(spark: SparkSession, d: str) -> DataFrame:
    """Where the files of one company's jobs are, for its dashboard; jobs without any are there with zeros."""
    jobs = M.guarded(table(spark, d, "nation"), "n_regionkey", 3).select(F.col("n_nationkey").alias("job"))
    people = table(spark, d, "customer").join(jobs, F.col("c_nationkey") == F.col("job")).select("job", "c_custkey")
    s = F.col("o_orderstatus")
    counts = table(spark, d, "orders").join(people, F.col("o_custkey") == F.col("c_custkey")).groupBy("job").agg(
        count_if(s == "O").alias("uploaded"), count_if(s == "P").alias("processing"), count_if(s == "F").alias("processed"), F.count("*").alias("total"),
    )
    out = jobs.join(counts, "job", "left").fillna(0)
    return out.withColumn("indexing_complete", (F.col("uploaded") + F.col("processing")) == 0)


@query("""SELECT o_orderkey AS ranking, o_totalprice >= 150000 AS passed, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_totalprice >= 150000) DESC,
  CASE WHEN o_totalprice >= 150000 THEN o_orderkey END NULLS LAST, o_totalprice DESC, o_orderkey) AS shown FROM orders""")
def passed_first_order(spark: SparkSession, d: str) -> DataFrame:
    """Each candidate's rows: passed ones by rank, then the others by score."""
    passed = F.col("o_totalprice") >= 150000
    w = Window.partitionBy("o_custkey").orderBy(passed.desc(), F.when(passed, F.col("o_orderkey")).asc_nulls_last(), F.col("o_totalprice").desc(), "o_orderkey")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("ranking"), passed.alias("passed"), F.row_number().over(w).cast("long").alias("shown"))


@query("""WITH f AS (SELECT text, count(*) AS n FROM documents GROUP BY 1) SELECT (SELECT count(*) FROM documents) AS total,
  (SELECT count(*) FROM documents WHERE length(trim(text)) = 0) AS empty, sum(n - 1)::bigint AS duplicate, count(*) AS ok FROM f WHERE length(trim(text)) > 0""")
def validation_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.sha2(F.col("text"), 256).alias("h"), (F.length(X.strip(F.coalesce("text", F.lit("")))) == 0).alias("empty"))
    groups = docs.groupBy("h", "empty").agg(F.count("*").alias("n"))
    full = ~F.col("empty")
    return groups.agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("empty"), F.col("n"))), F.lit(0)).alias("empty"), F.sum(F.when(full, F.col("n") - 1)).alias("duplicate"), F.count_if(full).alias("ok"))


@query("""SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_id, CASE WHEN row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1 THEN 'DUPLICATE' ELSE 'OK' END AS status FROM documents""")
def exact_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Later copies of a text point to the first; the least id of each hash is found before anything is joined."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("first_id"))
    return docs.join(first, "h").select("doc_id", "first_id", F.when(F.col("doc_id") == F.col("first_id"), "OK").otherwise("DUPLICATE").alias("status"))


@query("""SELECT CASE WHEN regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1) = '' THEN 'none' ELSE lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) END AS ext, count(*) AS files FROM pages GROUP BY 1""")
def ext_histogram(spark: SparkSession, d: str) -> DataFrame:
    ext = F.regexp_extract("url", r"\.([A-Za-z0-9]+)$", 1)
    return table(spark, d, "pages").groupBy(F.when(ext == "", "none").otherwise(F.lower(ext)).alias("ext")).agg(F.count("*").alias("files"))


@query("""WITH e AS (SELECT doc_id, 0.5 + quality / 2.0 AS faithfulness, 1.0 - toxic AS recall, 0.4 + quality * 0.3 AS relevance FROM labels)
  SELECT round(avg(faithfulness), 4) AS faithfulness, round(avg(recall), 4) AS recall, round(avg(relevance), 4) AS relevance, round(avg((recall = 0)::int), 4) AS failure_rate,
  round(avg((faithfulness < 0.85)::int), 4) AS hallucination_rate, round(0.4 * avg(recall) + 0.4 * avg(faithfulness) + 0.2 * avg(relevance), 4) AS rag_score FROM e""")
def rag_eval_summary(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "labels").select((0.5 + F.col("quality") / 2.0).alias("faithfulness"), (1.0 - F.col("toxic")).alias("recall"), (0.4 + F.col("quality") * 0.3).alias("relevance"))
    rate = lambda c: F.round(F.avg(c.cast("int")), 4)
    mean = [F.avg(c) for c in ("recall", "faithfulness", "relevance")]
    return e.agg(
        *(F.round(F.avg(c), 4).alias(c) for c in ("faithfulness", "recall", "relevance")), rate(F.col("recall") == 0).alias("failure_rate"),
        rate(F.col("faithfulness") < 0.85).alias("hallucination_rate"), F.round(0.4 * mean[0] + 0.4 * mean[1] + 0.2 * mean[2], 4).alias("rag_score"),
    )


_WATCHED = "[" + ", ".join(f"'{t}'" for t in [*config.WATCHED_TERMS, "der", "que"]) + "]"


@query(f"""WITH x AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev, (length(text) % 100) / 100.0 AS faith, turn % 4 AS recall FROM conversations),
  f AS (SELECT conv_id, turn, faith < 0.85 AS low_faith, recall = 0 AS no_context, list_filter({_WATCHED}, lambda t: contains(lower(text), t) AND NOT contains(lower(coalesce(prev, '')), t)) AS u,
  list_filter(['der.txt', 'que.pdf', 'the.txt'], lambda r: contains(lower(text), replace(replace(r, '.txt', ''), '.pdf', '')) AND r <> 'the.txt') AS n FROM x WHERE role = 'assistant')
  SELECT conv_id, turn, low_faith, no_context, array_to_string(u, ',') AS unsupported, array_to_string(n[1:3], ',') AS not_retrieved, low_faith OR no_context OR len(u) > 0 OR len(n) > 0 AS auto_fail FROM f""")
def rag_eval_flags(spark: SparkSession, d: str) -> DataFrame:
    """Answers that fail by themselves: low faithfulness, no context, watched terms that the context doesn't have, or
    expected files that the answer names although they weren't retrieved."""
    prev = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, d, "conversations").withColumn("prev", prev).where("role = 'assistant'")
    low, none = (F.length("text") % 100) / 100.0 < 0.85, F.col("turn") % 4 == 0
    bad = R.exceptional(F.col("text"), F.col("prev"), [*config.WATCHED_TERMS, "der", "que"])
    other = R.not_retrieved(F.col("text"), F.array(*map(F.lit, ["der.txt", "que.pdf", "the.txt"])), F.array(F.lit("the.txt")))
    fail = (low | none | (F.size(bad) > 0) | (F.size(other) > 0)).alias("auto_fail")
    return rows.select("conv_id", "turn", low.alias("low_faith"), none.alias("no_context"), F.array_join(bad, ",").alias("unsupported"), F.array_join(F.slice(other, 1, 3), ",").alias("not_retrieved"), fail)


@query("""SELECT user_id, count(*) AS calls, count(*) FILTER (hit) AS hits FROM (SELECT user_id, coalesce(ts - lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) <= INTERVAL 1 HOUR, false) AS hit FROM events) GROUP BY 1""")
def ttl_cache_hits(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    hit = F.coalesce(F.col("ts") - F.lag("ts").over(w) <= F.expr("INTERVAL 1 HOUR"), F.lit(False))
    return table(spark, d, "events").select("user_id", hit.alias("hit")).groupBy("user_id").agg(F.count("*").alias("calls"), F.count_if("hit").alias("hits"))


@query("""SELECT event_id, coalesce((props::json->>'k')::bigint, -1) AS k, 0.45 AS semantic, (ARRAY[0.3, 0.2])[event_id % 2 + 1] AS skill_match, (ARRAY[0.0, 2.0])[event_id % 2 + 1] AS min_years FROM events""")
def config_merge(spark: SparkSession, d: str) -> DataFrame:
    """Settings from JSON over defaults (broken JSON leaves the default), and a ranking configuration with overrides."""
    k = F.coalesce(F.from_json("props", "k long")["k"], F.lit(-1))
    plain = RankingConfig()
    other = plain.merged({"weights": {"skill_match": 0.2}, "hard_filters": {"min_experience_years": 2.0, "unknown": 1}})
    odd = F.col("event_id") % 2 == 1
    pick = lambda f: F.when(odd, F.lit(f(other))).otherwise(F.lit(f(plain)))
    return table(spark, d, "events").select("event_id", k.alias("k"), *(pick(lambda c, w=w: c.weights[w]).alias(w) for w in ("semantic", "skill_match")), pick(lambda c: c.min_experience_years).alias("min_years"))


@query("""SELECT c_custkey AS candidate, CASE WHEN p >= 80 THEN 'green' WHEN p >= 60 THEN 'yellow' ELSE 'red' END AS light, CASE WHEN length(c_name) > 14 THEN substr(c_name, 1, 14) || '...' ELSE c_name END AS label
  FROM (SELECT *, c_acctbal / 100 AS p FROM customer) WHERE contains(lower(c_name), 'mer#0000001') AND p BETWEEN 0 AND 95""")
def ui_filter_search(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("c_acctbal") / 100
    rows = table(spark, d, "customer").where(F.contains(F.lower("c_name"), F.lit("mer#0000001")) & p.between(0, 95))
    light = F.when(p >= 80, "green").when(p >= 60, "yellow").otherwise("red")
    return rows.select(F.col("c_custkey").alias("candidate"), light.alias("light"), X.excerpt(F.col("c_name"), 14).alias("label"))
