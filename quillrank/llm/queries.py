"""One query for each operator, over its whole table, and SQL where it can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.llm import bpe, chat, counts, exact, lexical, lm, mixing, neardup, periodic, quality, secrets, sharding, vectors
from quillrank.llm._scratch import Scratch, bounded_batches
from quillrank.llm.oracle import ORACLE

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
CONVERSATIONS = "conv_id long, turn long, role string, text string"
EMBEDDINGS = "vec_id long, embedding array<float>, label int"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.schema(DOCUMENTS).parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1
    model = lm.fit(docs.where(F.coalesce(~held_out, F.lit(True))), Scratch(spark, "lm"))
    scored = lm.score(docs, model)
    train = F.lit(model.tokens).cast("long")
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", train.alias("train_tokens"), "base_score", "score")


#: Tokenizer versions of the rollup, with their files.
VERSIONS = {"word-bpe-1": "word_bpe_49k.json", "byte-bpe-1": "byte_bpe_50k.json"}


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two tokenizers loaded; in the first one's counts an end token a text revised in; short documents
    deleted; one batch sent again."""
    docs = documents(spark, sf_dir)
    scratch = Scratch(spark, "counts")
    texts = docs.select("source", "lang", "text", mixing.n_words(F.col("text")).alias("words"))
    counted = bpe.count(texts, {v: tokenizer_path(file) for v, file in VERSIONS.items()})
    counted = scratch.save(counted.select("source", "lang", "tokenizer_version", "words", F.col("n_tokens").alias("n")), "base")
    base = [counted.where(F.col("tokenizer_version") == v) for v in VERSIONS]
    rollup = counts.Rollup(spark, scratch.path("rollup"))

    def changes(rows: DataFrame, op: str, now: str, old: str = "0") -> DataFrame:
        return rows.selectExpr("source", "lang", "tokenizer_version", f"'{op}' AS op", f"{now} AS n_tokens", f"{old} AS old_n_tokens")

    rollup.apply("0001-word-bpe", changes(base[0], "insert", "n"))
    rollup.apply("0002-byte-bpe", changes(base[1], "insert", "n"))
    rollup.apply("0003-ends", changes(base[0].where("words > 0"), "revise", "n + 1", "n"))
    rollup.compact()
    short = changes(base[0].where("words < 50"), "delete", "IF(words > 0, n + 1, n)").unionByName(changes(base[1].where("words < 50"), "delete", "n"))
    rollup.apply("0004-short", short)
    rollup.apply("0002-byte-bpe", changes(base[1], "insert", "n"))
    return scratch.last(rollup.totals())


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), neardup.Near(shingle=3, percent=85, rows=6, bands=32))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir).select("doc_id", "text"))
    n = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("found", lambda s: s["kind"].isin([r.kind for r in secrets.BASE]))
    return found.select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("found")).alias("spans"),
    )


def op5_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(spark.read.schema(EMBEDDINGS).parquet(f"{sf_dir}/embeddings.parquet"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    ids = bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), path, back=True)
    return ids.select(
        "doc_id",
        F.call_function("div", F.octet_length("ids"), F.lit(4)).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "quality")
    found = scratch.save(quality.with_fields(documents(spark, sf_dir)), "fields")
    sketches = quality.sketch(found.where(~F.col("base_failed")), quality.sketched(quality.FENCES))
    # a group with no document that passes the base rules has no thresholds: all of it is rejected already
    limits = scratch.save(quality.thresholds(sketches), "limits")
    judged = quality.judge(found.where(~F.col("base_failed")), limits).unionByName(found.where("base_failed").withColumn("kept", F.lit(False)))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.read.schema(CONVERSATIONS).parquet(f"{sf_dir}/conversations.parquet")
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], CONVERSATIONS)
    return chat.digest(chat.expand(own.unionByName(more)))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir), weights=[3, 1, 2])
    taken = (F.col("size") * F.size("draws")).cast("long")
    return mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.col("draws.shard").alias("shards"), F.col("draws.at").alias("places"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = sharding.assign_shards(rows, "doc_id", 40, ["size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(documents(spark, sf_dir))


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; in a tenth of the documents, told by crc32 of the id, a stretch of words repeats to the end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    div = lambda a, b: F.call_function("div", a, b)
    own = docs.where((h % 10 == 0) & F.col("doc_id").isNotNull()).select("doc_id", "text", div(h, F.lit(10)).alias("g"), F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0).alias("w"))
    own = own.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    own = own.withColumn("p", 1 + div(F.col("n") - F.col("a"), 3 + F.col("g") % 8))
    whole = lambda c: c.cast("int")
    tail = F.flatten(F.array_repeat(F.slice("w", whole(F.col("a") + 1), whole(F.col("p"))), whole(div(F.col("n") - F.col("a"), F.col("p")) + 1)))
    more = F.concat(F.slice("w", 1, whole(F.col("a"))), F.slice(tail, 1, whole(F.col("n") - F.col("a"))))
    return docs.where(F.coalesce(h % 10 != 0, F.lit(True))).select("doc_id", "text").unionByName(own.select("doc_id", F.when(F.col("n") > 0, F.array_join(more, " ")).otherwise(F.col("text")).alias("text")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = planted(documents(spark, sf_dir)).select("doc_id", periodic.periodic_runs(F.col("text")).alias("f")).select("doc_id", "f.runs", "f.collapsed")
    first = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    found = found.withColumn("top", first)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.period")).alias("period"),
        F.call_function("div", 1000 * F.col("top.length"), -F.col("top.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "lexical")
    index = lexical.build(documents(spark, sf_dir), scratch)
    items = spark.read.schema("item_id long, text string").parquet(f"{sf_dir}/benchmark.parquet")
    return scratch.last(lexical.search(index, items, scratch))


QUERIES = {
    f.__name__: f
    for f in (
        op1_lm_scoring, op2_token_counts, op3_near_duplicates, op4_secret_scan, op5_embedding_duplicates,
        op6_bpe, op7_quality_rules, op8_chat, op9_mixing, op10_sharding,
        op11_exact_dedup, op12_periodic_runs, op13_lexical_search,
    )
}
__all__ = ["ORACLE", "QUERIES"]
