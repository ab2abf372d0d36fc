"""A corpus pipeline of five stages, each of which works on all that the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.llm import bpe, mixing, neardup, quality, queries, secrets
from quillrank.llm._scratch import Scratch, bounded_batches, shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed base rules or their group's thresholds reject go.

    So do null, empty and very short texts, which the base rules reject. Null languages and sources are groups of their
    own; repeated rows are judged each; all columns stay, whatever their names. No rows give none.
    """
    bounded_batches(spark)
    return quality.filter_docs(docs, Scratch(spark, "quality").save)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five-word shingles and a similarity of 0.8 join, one with the least id stays.

    Texts without words stay all. Rows are told apart by id and text, so that ids may be null or repeated; of equal rows
    one stays; all columns stay, whatever their names. No rows give none.
    """
    bounded_batches(spark)
    return neardup.one_of_each(docs, neardup.Near(shingle=5, percent=80, rows=5, bands=40))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays, with null or empty texts and repeated rows as they are.

    All columns stay, whatever their names, but for one called `found`, which gives way. No rows give none.
    """
    return secrets.redact(secrets.scan(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 3, 1, 2 share 150 % of all words: documents are left out, or there once or twice, in the order
    in which the tree deals them to 64 shards.

    A null text has no words and goes with its place in line, a null source is a source; equal rows, and rows with null
    or repeated ids, are documents of their own. No rows give none.
    """
    return mixing.materialise(docs, weights=[3, 1, 2], name=None)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, and the SHA-256 of the text that they decode to.

    A null or empty text has no ids; repeated rows have theirs each; other columns are left out. No rows give none.
    """
    bounded_batches(spark)
    path = queries.tokenizer_path()
    out = bpe.encode(docs.select("doc_id", "source", "text"), path, back=True)
    return out.select(
        "doc_id", "source",
        F.call_function("div", F.octet_length("ids"), F.lit(4)).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [("quality", quality_rules), ("near_dedup", near_dedup), ("secrets", secret_scan), ("mix", mix_sources), ("bpe", tokenise)]

#: BPE has no SQL; tests/llm compares the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each written and read again as the next one's input."""
    docs = queries.documents(spark, sf_dir)
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex[:12]}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{root}/{i}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{root}/{i}-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
