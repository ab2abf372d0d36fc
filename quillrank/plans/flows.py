"""Work that goes on from batch to batch: growing taxonomies, queues, keys that were seen, published rankings."""

from __future__ import annotations

from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.config import RankingConfig
from quillrank.operators import ranking as R
from quillrank.operators import records as N
from quillrank.operators.taxonomy import Taxonomy
from quillrank.plans import scoring
from quillrank.plans.base import query, table
from quillrank.session import scratch_folder
from quillrank.sources.versions import Versions
from quillrank.streaming.queue import Queue, Seen

#: The test vectors are far from each other; at the production value of 0.85 all would be entries of their own.
NEAR = 0.3

_UNIT = "list_transform(embedding, lambda x: x::double / sqrt(list_dot_product(embedding::double[], embedding::double[])))"


@query(f"""WITH RECURSIVE v AS (SELECT list({_UNIT} ORDER BY vec_id) AS vs, list(vec_id ORDER BY vec_id) AS ids FROM embeddings),
  g AS (SELECT 1 AS i, [1]::bigint[] AS l FROM v UNION ALL SELECT i + 1, CASE WHEN len(list_filter(l, lambda k: round(list_dot_product(vs[k], vs[i + 1]), 9) > {NEAR})) = 0 THEN list_append(l, i + 1) ELSE l END FROM g, v WHERE i < len(ids)),
  l AS (SELECT ids[k] AS canon, vs[k] AS c FROM (SELECT unnest(arg_max(l, i)) AS k FROM g), v),
  m AS (SELECT vec_id, canon, round(list_dot_product(c, {_UNIT}), 9) AS cos FROM embeddings JOIN l ON canon <= vec_id)
  SELECT vec_id, 'skill ' || arg_max(canon, (cos, -canon)) AS canonical FROM m GROUP BY 1""")
def taxonomy_grown(spark: SparkSession, d: str) -> DataFrame:
    """Every vector as a skill, in the order of ids and in four batches: the canonical entry that each maps to when it
    comes."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("at"), F.format_string(" Skill %d", "vec_id").alias("name"), F.col("embedding").alias("vec"))
    most = rows.agg(F.max("at")).first()[0] or 0
    grown = Taxonomy(rows, NEAR)
    for k in range(4):
        grown.add(rows.where(F.call_function("div", 4 * F.col("at"), F.lit(most + 1)) == k), k)
    return grown.mapped().select(F.col("at").alias("vec_id"), "canonical")


@query("""WITH k AS (SELECT doc_id, text, length(text) < 300 AS short FROM documents), f AS (SELECT *, min(doc_id) OVER (PARTITION BY text, short) AS first FROM k)
  SELECT doc_id, CASE WHEN short THEN 'failed' WHEN first < doc_id THEN 'duplicate' ELSE 'processed' END AS state, CASE WHEN short THEN 'too short' WHEN first < doc_id THEN 'copy of ' || first END AS reason, 3 AS changes FROM f""")
def status_queue(spark: SparkSession, d: str) -> DataFrame:
    """Documents come in by a stream and are worked on step by step; each step is killed once and run again."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    h = F.sha2("text", 256)
    first = docs.where(F.length("text") >= 300).groupBy(h.alias("h")).agg(F.min("id").alias("first"))
    queue, killed = Queue(spark, scratch_folder(spark)), []

    def work(claimed: DataFrame) -> DataFrame:
        if len(killed) < k + 1:
            killed.append(k)
            raise RuntimeError("killed")
        own = docs.join(claimed, "id").withColumn("h", h).join(first, "h", "left")
        short, copy = F.length("text") < 300, F.col("first") < F.col("id")
        state = F.when(short, "failed").when(copy, "duplicate").otherwise("processed")
        return own.select("id", state.alias("state"), F.when(short, "too short").when(copy, F.concat(F.lit("copy of "), F.col("first").cast("string"))).alias("reason"))

    most = docs.agg(F.max("id")).first()[0] or 0
    for k in range(3):
        queue.submit(docs.where(F.call_function("div", 3 * F.col("id"), F.lit(most + 1)) == k), k)
        with suppress(RuntimeError):
            queue.run(k, work)
        queue.run(k, work)
    return queue.states().select(F.col("id").alias("doc_id"), "state", "reason", "changes")


@query("SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY text UNION ALL SELECT doc_id FROM documents WHERE text IS NULL")
def first_seen_stored(spark: SparkSession, d: str) -> DataFrame:
    """The first document of each text that comes in, in five runs of a stream, against a table of keys that is merged on the
    way."""
    seen, out, folder = Seen(spark, scratch_folder(spark), merge=2), scratch_folder(spark), scratch_folder(spark)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    most = docs.agg(F.max("id")).first()[0] or 0
    put = lambda batch, number: seen.first(batch, number).write.mode("overwrite").parquet(f"{out}/rows/{number}")
    for k in range(5):
        docs.where(F.call_function("div", 5 * F.col("id"), F.lit(most + 1)) == k).write.mode("append").parquet(folder)
        arriving = spark.readStream.schema("id long, text string").parquet(folder)
        arriving.writeStream.foreachBatch(put).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows/*").select(F.col("id").alias("doc_id"))


_MODES = "CASE WHEN job = 1 THEN 'contextual' ELSE 'keyword' END"
_WEIGHTS = "CASE WHEN job = 1 THEN 0.25 * semantic + 0.25 * skill + 0.25 * experience + 0.25 * education ELSE 0.45 * semantic + 0.3 * skill + 0.15 * experience + 0.1 * education END"


@query(f"""WITH {scoring._JOB}, f2 AS (SELECT x.*, top, CASE WHEN skill >= 0.1 AND years >= 3 THEN {_WEIGHTS} ELSE 0 END AS total FROM x JOIN (SELECT candidate AS c, top FROM sem) ON c = candidate),
  t AS (SELECT candidate, string_agg(substr(text, 1, 200), '|' ORDER BY nth) AS chunks FROM r JOIN documents ON doc_id = chunk WHERE nth <= 3 GROUP BY 1)
  SELECT job, f2.candidate, round(total, 4)::double AS final, row_number() OVER (PARTITION BY job ORDER BY round(total, 4) DESC, f2.candidate) AS rank_position, {_MODES} AS mode, CASE WHEN job = 1 THEN 0.25 ELSE 0.45 END::double AS semantic_weight, chunks
  FROM f2 LEFT JOIN t ON t.candidate = f2.candidate""")
def ranking_published(spark: SparkSession, d: str) -> DataFrame:
    """Rankings of all jobs, written with their best chunks' texts, mode and settings; then one job's again with other
    weights, which replaces that job's rankings and settings by one pointer, and both tables read back."""
    chunks = scoring._semantic(spark, d).select("candidate", F.posexplode("top").alias("nth", "chunk"))
    texts = chunks.join(table(spark, d, "documents"), F.col("chunk") == F.col("doc_id"))
    best = texts.groupBy("candidate").agg(F.array_sort(F.collect_list(F.struct("nth", F.substring("text", 1, 200).alias("text")))).alias("c"))
    features = scoring._features(spark, d).join(best.select("candidate", F.transform("c", lambda x: x["text"]).alias("chunks")), "candidate", "left")
    store = Versions(spark, scratch_folder(spark))

    def publish(jobs: DataFrame, override: dict, mode: str) -> None:
        cfg = RankingConfig().merged({"hard_filters": {"min_skill_overlap": 0.1, "min_experience_years": 3}, **override})
        rows = R.scored(jobs, cfg, "candidate")
        settings = F.create_map(*(F.lit(x) for kv in cfg.weights.items() for x in kv))
        store.commit({"rankings": rows.withColumn("mode", F.lit(mode)), "settings": jobs.select("job").distinct().withColumn("weights", settings)})

    publish(features, {}, "keyword")
    publish(features.where("job = 1"), {"weights": dict.fromkeys(RankingConfig().weights, 0.25)}, "contextual")
    store.vacuum()
    both = store.read("rankings").join(store.read("settings"), "job")
    return both.select("job", "candidate", "final", "rank_position", "mode", F.col("weights")["semantic"].alias("semantic_weight"), F.array_join("chunks", "|").alias("chunks"))


@query("""WITH a AS (SELECT s_suppkey AS job, s_suppkey % 3 AS kind, s_name FROM supplier)
  SELECT job, CASE kind WHEN 0 THEN 'ready' WHEN 1 THEN 'failed' ELSE 'ready' END AS status, CASE kind WHEN 0 THEN 'sql=postgres ' || job || '|mysql' WHEN 2 THEN 'cloud=aws' END AS implied, CASE kind WHEN 0 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS implied_total,
    CASE kind WHEN 0 THEN 'Sure: {"SQL ": ["Postgres ' || job || '", "MySQL"]}' WHEN 1 THEN 'none for ' || s_name ELSE '{"Cloud": ["AWS"]}' END AS raw FROM a""")
def skill_map_stored(spark: SparkSession, d: str) -> DataFrame:
    """Skill maps of all jobs with their counts, beside the raw answers that they come from; a third of the jobs are asked
    again, and their maps and answers change together."""
    jobs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("job"), F.col("s_name"))
    kind, key = F.col("job") % 3, F.col("job").cast("string")
    first = F.when(kind == 0, F.concat(F.lit('Sure: {"SQL ": ["Postgres '), key, F.lit('", "MySQL"]}'))).otherwise(F.concat(F.lit("none for "), "s_name"))
    store = Versions(spark, scratch_folder(spark))

    def put(rows: DataFrame) -> None:
        maps = rows.select("job", "s_name", N.map_status(F.col("raw")).alias("status"), N.implied_map(F.col("raw")).alias("implied"))
        meta = N.map_meta(N.ready_map(F.col("status"), F.col("implied")), F.col("s_name"))
        store.commit({"answers": rows.select("job", "raw"), "maps": maps.withColumn("meta", meta).drop("s_name")})

    put(jobs.withColumn("raw", first))
    put(jobs.where(kind == 2).withColumn("raw", F.lit('{"Cloud": ["AWS"]}')))
    flat = F.array_join(F.transform(F.map_entries("implied"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "|"))), ";")
    return store.read("maps").join(store.read("answers"), "job").select("job", "status", flat.alias("implied"), F.col("meta.implied_skills_total").alias("implied_total"), "raw")
