"""Rankings, coverage and retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillrank import config
from quillrank.config import RankingConfig
from quillrank.functions import dates as D
from quillrank.functions import text as X
from quillrank.operators import ranking as R
from quillrank.operators.sections import TermIndex, keyword_scores, whole
from quillrank.operators.taxonomy import nearest
from quillrank.plans.base import query, table
from quillrank.plans.sql import skills_sql, tfidf_sql

#: Skills that descriptions and documents are compared by: the default ones, which the test tables hardly hold, and words.
VOCABULARY = [*config.SKILLS, "license", "the", "that", "of the", "die", "und", "les", "dans", "los", "para"]


def asked(spark: SparkSession, d: str, n: int, where: str = "true") -> DataFrame:
    """(item, terms, skills) of the descriptions: 1- to n-grams and extracted skills."""
    rows = table(spark, d, "benchmark").where(where)
    return rows.select(F.col("item_id").alias("item"), X.terms(F.col("text"), n, config.STOP_WORDS).alias("terms"), X.extract_skills(F.col("text"), VOCABULARY).alias("skills"))


@query(f"WITH {tfidf_sql(2, '{n}')} SELECT item_id, doc_id, round(tfidf, 6) AS tfidf FROM s")
def tfidf_cosine(spark: SparkSession, d: str) -> DataFrame:
    """The plain vectoriser: 1- and 2-grams less stop words, raw counts; all descriptions and documents that share one."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    index = TermIndex(docs, "doc_id", whole(X.terms(F.col("text"), 1, config.STOP_WORDS)), sublinear=False, n=2).checked()
    return index.cosines(asked(spark, d, 2)).select(F.col("item").alias("item_id"), "doc_id", F.round("cos", 6).alias("tfidf"))


def _keyword_sql(where: str) -> str:
    return f"""WITH {tfidf_sql(3, '(1 + ln({n}))', where)}, js AS (SELECT item_id, {skills_sql("text", VOCABULARY)} AS want FROM benchmark WHERE {where}), ds AS (SELECT doc_id, {skills_sql("text", VOCABULARY)} AS own FROM documents),
  k AS (SELECT js.item_id, ds.doc_id, coalesce(tfidf, 0) AS tfidf, CASE WHEN len(want) > 0 THEN len(list_intersect(want, own)) / len(want)::double ELSE 0 END AS skill, list_sort(list_intersect(want, own)) AS matched, list_sort(list_filter(want, lambda x: NOT list_contains(own, x))) AS missing
    FROM js CROSS JOIN ds LEFT JOIN s ON s.item_id = js.item_id AND s.doc_id = ds.doc_id),
  f AS (SELECT *, greatest(0, least(1, 0.7::double * tfidf + 0.3::double * skill)) AS final FROM k),
  r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(final, 12) DESC, round(tfidf, 12) DESC, doc_id) AS rank FROM f)
  SELECT item_id, doc_id, round(tfidf, 4) AS tfidf, round(skill, 4) AS skill, round(final, 4) AS final, rank, array_to_string(matched, ',') AS matched, array_to_string(missing, ',') AS missing FROM r WHERE rank <= 10"""


def _keyword(spark: SparkSession, d: str, where: str) -> DataFrame:
    docs, wanted = table(spark, d, "documents").select("doc_id", "text"), asked(spark, d, 3, where)
    index = TermIndex(docs, "doc_id", whole(X.terms(F.col("text"), 1, config.STOP_WORDS)), n=3).checked()
    own = docs.select("doc_id", X.extract_skills(F.col("text"), VOCABULARY).alias("skills"))
    best = keyword_scores(index.similarities(wanted, {"all": 1.0}), own, wanted, "doc_id", 10)
    return best.select(F.col("item").alias("item_id"), "doc_id", *(F.round(c, 4).alias(c) for c in ("tfidf", "skill", "final")), "rank", *(F.array_join(c, ",").alias(c) for c in ("matched", "missing")))


@query(_keyword_sql("item_id = 0"))
def keyword_rank_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten best documents for one description: 0.7 TF-IDF cosine + 0.3 share of its skills that are there, with the
    matched and the missing ones."""
    return _keyword(spark, d, "item_id = 0")


@query(_keyword_sql("true"))
def keyword_rank_all(spark: SparkSession, d: str) -> DataFrame:
    """The ten best for each description, from one index."""
    return _keyword(spark, d, "true")


def _words(name: str) -> Column:
    return F.array_distinct(F.flatten(F.collect_list(F.split(name, " "))))


_OWN = "own AS (SELECT l_suppkey AS s, list_distinct(flatten(list(string_split(p_name, ' ')))) AS own FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1), want AS (SELECT ['red', 'widget', 'small', 'cloud'] AS w)"
WANTED = ["red", "widget", "small", "cloud"]
IMPLIED = {"cloud": ["ring", "bolt"], "widget": ["gear"], "red": []}


def _own(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier's words, from the distinct names of its parts: a row a name, not a row a sale."""
    items = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    named = items.join(table(spark, d, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", "p_name").distinct()
    return named.groupBy(F.col("l_suppkey").alias("s")).agg(_words("p_name").alias("own"))


def _wanted() -> Column:
    return F.array(*map(F.lit, WANTED))


@query(f"""WITH {_OWN} SELECT s, array_to_string(list_sort(list_intersect(w, own)), ',') AS matched, array_to_string(list_sort(list_filter(w, lambda x: NOT list_contains(own, x))), ',') AS missing,
  round(len(list_intersect(w, own)) / 4.0::double, 4) AS overlap, round(len(list_intersect(w, own)) / len(list_distinct(list_concat(w, own)))::double, 4) AS jaccard FROM own, want""")
def skill_match_explain(spark: SparkSession, d: str) -> DataFrame:
    own = F.col("own")
    rows = _own(spark, d).select("s", *R.explained(_wanted(), own), F.round(R.overlap(_wanted(), own), 4).alias("overlap"), F.round(R.jaccard(_wanted(), own), 4).alias("jaccard"))
    return rows.withColumns({c: F.array_join(c, ",") for c in ("matched", "missing")})


@query(f"""WITH {_OWN}, m AS (SELECT s, own, list_filter(w, lambda x: NOT list_contains(own, x)) AS missing, len(list_intersect(w, own)) AS hit FROM own, want),
  c AS (SELECT *, list_filter(missing, lambda x: len(list_intersect(coalesce(MAP {{'cloud': ['ring', 'bolt'], 'widget': ['gear'], 'red': []}}[x], []), own)) > 0) AS cov FROM m)
  SELECT s, array_to_string(list_sort(cov), ',') AS covered, array_to_string(list_sort(list_filter(missing, lambda x: NOT list_contains(cov, x))), ',') AS truly_missing, round(least(1.0, (hit + 0.6 * len(cov)) / 4.0::double), 4)::double AS score FROM c""")
def implied_coverage(spark: SparkSession, d: str) -> DataFrame:
    implied = F.create_map(*(x for k, v in IMPLIED.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))))
    missing = F.array_except(_wanted(), F.col("own"))
    rows = _own(spark, d).withColumn("cov", R.covered(missing, F.col("own"), implied))
    names = F.transform("cov", lambda x: x["skill"])
    return rows.select("s", F.array_join(F.array_sort(names), ",").alias("covered"), F.array_join(F.array_sort(F.array_except(missing, names)), ",").alias("truly_missing"), F.round(R.contextual(_wanted(), F.col("own"), F.col("cov")), 4).alias("score"))


_COS = "list_dot_product(a.embedding::double[], b.embedding::double[]) / (sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) * sqrt(list_dot_product(b.embedding::double[], b.embedding::double[])))"
_SEM = f"""c AS (SELECT b.label AS candidate, b.vec_id AS chunk, max({_COS}) AS cos FROM embeddings a, embeddings b WHERE a.vec_id < 5 GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY cos DESC, chunk DESC) AS nth FROM c), sem AS (SELECT candidate, avg(cos) AS semantic, string_agg(chunk::varchar, ',' ORDER BY nth) AS top FROM r WHERE nth <= 3 GROUP BY 1)"""


def _semantic(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    wanted = e.where("vec_id < 5").select(F.col("vec_id").alias("w_id"), F.col("embedding").alias("w_vec"))
    return R.semantic(wanted, e.select(F.col("label").alias("candidate"), F.col("vec_id").alias("chunk_idx"), F.col("embedding").alias("vec")))


@query(f"WITH {_SEM} SELECT candidate, round(semantic, 4) AS semantic, top FROM sem")
def cosine_matrix_top3(spark: SparkSession, d: str) -> DataFrame:
    return _semantic(spark, d).select("candidate", F.round("semantic", 4).alias("semantic"), F.array_join(F.transform("top", lambda x: x.cast("string")), ",").alias("top"))


_D2 = f"round(greatest(2 - 2 * ({_COS}), 0), 6)"
_NEAR = f"SELECT a.vec_id AS q, b.vec_id AS id, {_D2} AS d2, round(1 / (1 + {_D2}), 4) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {_D2}, b.vec_id) <= 50"


def _nearest(spark: SparkSession, d: str) -> DataFrame:
    """The fifty nearest of every twentieth vector (the query set) among all."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return R.nearest_l2(e, e.where("id % 20 = 0").select(F.col("id").alias("q"), F.col("vec").alias("q_vec")), 50)


@query(_NEAR)
def vector_topk_l2(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d)


_KNOWN = f"""v AS ({_NEAR}), p AS (SELECT q, id, d2, similarity, n_chars, text, CASE WHEN n_chars IS NULL THEN 999 ELSE n_chars % 60 END AS rank, coalesce(n_chars % 100 / 100.0, 0.0) AS prior,
  CASE WHEN contains(lower(text), 'the') THEN 0.5 ELSE 0 END + CASE WHEN contains(lower(text), 'license') THEN 0.5 ELSE 0 END AS skill, 'd' || doc_id || '.txt' AS filename FROM v JOIN documents ON doc_id = id)"""


@query(f"""WITH {_KNOWN}, s AS (SELECT *, 0.4::double * similarity + 0.3::double * prior + 0.3::double * skill AS s FROM p)
  SELECT q, filename, rank, round(s, 4)::double AS combined, CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '...' ELSE text END AS excerpt FROM s
  WHERE rank <= 45 AND rank >= 2 AND s >= 0.2 AND skill > 0 QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(s, 4) DESC, d2, id) <= 10""")
def two_stage_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Fifty nearest vectors a query, those of known files joined with their earlier ranking, filtered (rank from 2 to 45,
    a least score, any of the required skills), scored anew, ten kept."""
    hits = _known(spark, d).withColumn("s", R.combined(F.col("similarity"), F.col("skill"), F.col("prior")))
    fine = hits.where(R.retrieved(F.col("rank"), F.col("s"), F.col("skills"), least_rank=45, most_rank=2, least_score=0.2, required=["The", "license"]))
    return _best(fine)


@query(f"""WITH {_KNOWN}, s AS (SELECT *, 0.6::double * similarity + 0.4::double * skill AS s FROM p)
  SELECT q, filename, rank, round(s, 4)::double AS combined, CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '...' ELSE text END AS excerpt FROM (SELECT * REPLACE (999 AS rank) FROM s)
  QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(s, 4) DESC, d2, id) <= 10""")
def retrieval_without_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The same where nothing was ranked before: similarity and skills alone."""
    hits = _known(spark, d).withColumn("rank", F.lit(999).cast("long"))
    return _best(hits.withColumn("s", R.combined(F.col("similarity"), F.col("skill"))))


def _known(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "text", F.format_string("d%d.txt", "doc_id").alias("filename"))
    skills = F.filter(F.array(F.lit("the"), F.lit("license")), lambda w: F.contains(F.lower("text"), w))
    hits = _nearest(spark, d).join(docs, F.col("id") == F.col("doc_id")).withColumn("skills", skills)
    rank, prior = F.coalesce(F.col("n_chars") % 60, F.lit(999)), F.coalesce(F.col("n_chars") % 100 / 100.0, F.lit(0.0))
    return hits.withColumns({"rank": rank, "prior": prior, "skill": F.size("skills") / 2})


def _best(hits: DataFrame) -> DataFrame:
    by = Window.partitionBy("q").orderBy(F.round("s", 4).desc(), "d2", "id")
    return hits.withColumn("_n", F.row_number().over(by)).where("_n <= 10").select("q", "filename", "rank", F.round("s", 4).alias("combined"), X.excerpt(F.col("text")).alias("excerpt"))


@query(f"""WITH m AS (SELECT b.vec_id AS raw, a.vec_id AS skill, {_COS} AS cos FROM embeddings a, embeddings b WHERE a.vec_id < 40),
  t AS (SELECT *, row_number() OVER (PARTITION BY raw ORDER BY round(cos, 9) DESC, skill) AS nth FROM m) SELECT raw, CASE WHEN cos > 0.85 THEN skill END AS skill FROM t WHERE nth = 1""")
def taxonomy_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Each vector's nearest of 40 fixed skills, if its cosine is over 0.85."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("at"), F.col("embedding").alias("vec"))
    best = nearest(e, e.where("at < 40"), ordered=False)
    return best.select(F.col("at").alias("raw"), F.when(F.col("cos") > 0.85, F.col("canon")).alias("skill"))


_JOB = f"""{_SEM}, {_OWN}, f AS (SELECT candidate, semantic, len(list_intersect(w, own)) / len(list_distinct(list_concat(w, own)))::double AS skill, (candidate * 3) % 16 + 0.5 AS years, candidate % 5 / 4.0::double AS education, candidate % 3 AS job, list_sort(list_intersect(w, own)) AS matched, list_sort(list_filter(w, lambda e: NOT list_contains(own, e))) AS missing
  FROM sem JOIN own ON s = candidate, want), x AS (SELECT *, 0.7 * least(ln(1 + years) / ln(16), 1) + 0.3 * 0.5 AS experience FROM f)"""


def _features(spark: SparkSession, d: str) -> DataFrame:
    both = _semantic(spark, d).join(_own(spark, d), F.col("candidate") == F.col("s"))
    years = (F.col("candidate") * 3) % 16 + 0.5
    recent = D.recency(F.lit(None).cast("date"), F.to_date(F.lit("2026-01-01")))
    job, tier = F.col("candidate") % 3, F.col("candidate") % 5
    return both.select("candidate", job.alias("job"), "semantic", *R.explained(_wanted(), F.col("own")), R.jaccard(_wanted(), F.col("own")).alias("skill"), years.cast("double").alias("years"), D.experience_score(years.cast("double"), recent).alias("experience"), R.education(tier).alias("education"))


_LIMITS = "skill >= 0.1 AND years >= 3"


@query(f"""WITH {_JOB} SELECT job, candidate, {_LIMITS} AS passed, array_to_string(matched, ',') AS matched, array_to_string(missing, ',') AS missing, round(semantic, 4) AS semantic, round(skill, 4) AS skill, round(experience, 4) AS experience, round(education, 4) AS education,
  round(CASE WHEN {_LIMITS} THEN 0.45 * semantic + 0.3 * skill + 0.15 * experience + 0.1 * education ELSE 0 END, 4)::double AS final,
  row_number() OVER (PARTITION BY job ORDER BY round(CASE WHEN {_LIMITS} THEN 0.45 * semantic + 0.3 * skill + 0.15 * experience + 0.1 * education ELSE 0 END, 4) DESC, candidate) AS rank_position FROM x""")
def job_rank_keyword(spark: SparkSession, d: str) -> DataFrame:
    cfg = RankingConfig().merged({"hard_filters": {"min_skill_overlap": 0.1, "min_experience_years": 3}})
    rows = R.scored(_features(spark, d), cfg, "candidate").drop("years")
    return rows.withColumns({c: F.array_join(c, ",") for c in ("matched", "missing")})


@query(f"""WITH {_JOB}, y AS (SELECT job, candidate, {_LIMITS} AS passed, round(semantic, 4) AS a, round(skill, 4) AS b, round(experience, 4) AS c, round(education, 4) AS e FROM x)
  SELECT job, candidate, round(CASE WHEN passed THEN 0.25 * a + 0.25 * b + 0.25 * c + 0.25 * e ELSE 0 END, 4)::double AS final, row_number() OVER (PARTITION BY job ORDER BY round(CASE WHEN passed THEN 0.25 * a + 0.25 * b + 0.25 * c + 0.25 * e ELSE 0 END, 4) DESC, candidate) AS rank_position FROM y""")
def rerank_weights(spark: SparkSession, d: str) -> DataFrame:
    w = {"semantic": 0.25, "skill_match": 0.25, "experience": 0.25, "education": 0.25}
    return R.reranked(job_rank_keyword(spark, d), w, "candidate").select("job", "candidate", "final", "rank_position")
