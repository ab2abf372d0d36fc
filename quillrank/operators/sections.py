"""TF-IDF of whole documents and by section, over an inverted index that is written once."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quillrank.operators import grams as G
from quillrank.session import scratch_folder, set_for, small_batches

#: Parts that terms are dealt into at least, and bytes of text for which there is one task more.
LEAST_BUCKETS, TEXT = 16, 8 << 20
#: Terms of descriptions that tasks get at once.
WANTED = 100_000


def text_bytes(docs: DataFrame) -> int:
    """Bytes of the documents' strings."""
    texts = [F.sum(F.octet_length(F.col(f"`{f.name}`"))) for f in docs.schema if f.dataType.simpleString() == "string"]
    return sum(x or 0 for x in docs.agg(*texts).first()) if texts else 0


def tasks(docs: DataFrame, each: int, size: int | None = None) -> int:
    """Tasks so that one has about `each` bytes of the documents' strings, and as many as the session's shuffle partitions."""
    size = text_bytes(docs) if size is None else size
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _arrow(columns: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(columns))


def _map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def whole(terms: Column, name: str = "all") -> Column:
    return F.array(F.struct(F.lit(name).alias("section"), terms.alias("terms")))


class TermIndex:
    """What a vectoriser learns from documents, in tables of shared storage, and the cosines of descriptions with them.

    Texts are split once. Terms are a section's 1- to `n`-grams of words. Each section has a vocabulary and an idf (smoothed,
    plus 1) of its own, of its documents with terms; sections that are empty or null have none. Terms in under `min_df` of a
    section's documents don't count, unless the section has under three or no term would be left. Tables: `chunks`, the words
    of documents (operators.grams), and `norms` (chunk, slot, key, section, norm). `postings` are what chunks send to those who
    count in how many documents a term is; answers come back to the chunk, so that no table has a row or a number for each
    document and bucket. A document is told by its chunk and its place there. Tasks are as many as the texts need.
    """

    def __init__(self, docs: DataFrame, key: str, sections: Column, sublinear: bool = True, min_df: int = 1, n: int = 1):
        """`sections` is an array of (section, terms) with arrays of words, which hold no blanks if `n` is above 1; a section may
        come more than once."""
        self.spark, self.root, self.key, self.n = docs.sparkSession, scratch_folder(docs.sparkSession), key, n
        self.sublinear = sublinear
        size = text_bytes(docs)
        self.parts = tasks(docs, TEXT, size)
        self.dealt = max(LEAST_BUCKETS, self.parts)
        self._kind = docs.schema[key].dataType.simpleString()
        small_batches(self.spark)
        rows = docs.repartition(self.parts, key).sortWithinPartitions(key).select(key, sections.alias("sections"))
        columns = f"chunk long, keys array<{self._kind}>, names array<string>, docs array<long>, data binary"
        self.chunks = self._saved(rows.mapInArrow(G.stored(key, TEXT, _arrow(columns)), columns), "chunks")
        # a row a section is read to the driver
        each = self.chunks.select(F.explode(F.arrays_zip("names", "docs")).alias("s")).groupBy("s.names").agg(F.sum("s.docs").alias("n"))
        self.sizes = {r["names"]: r["n"] for r in each.where("n > 0").collect()}
        last = G.frequent(docs, key, sections, size, self.dealt)
        self.postings = self.chunks.select("chunk", "data").mapInArrow(G.dealt(n, self.dealt, last), "bucket int, chunk long, data binary")
        # stored, so that the postings' shuffle is gone before chunks meet their answers
        answers = self._saved(self.postings.repartitionById(self.dealt, "bucket").mapInArrow(G.documents(n), "bucket int, chunk long, data binary"), "answers")
        both = answers.unionByName(self.chunks.select("chunk", "keys", "data"), allowMissingColumns=True).repartition(self.parts, "chunk").groupBy("chunk")
        columns = f"chunk long, slot long, {key} {self._kind}, section string, every double, fine double, most long"
        norms = self._saved(both.applyInArrow(G.lengths(n, self.dealt, last, self.sizes, sublinear, min_df, _arrow(columns)), columns), "norms")
        most = {r["section"]: r["most"] for r in norms.groupBy("section").agg(F.max("most").alias("most")).collect()}
        self.least = {s: min_df if d >= 3 and most[s] >= min_df else 1 for s, d in self.sizes.items()}
        fine = [s for s, d in self.least.items() if d > 1]
        norm = F.when(F.col("section").isin(*fine), F.col("fine")).otherwise(F.col("every")) if fine else F.col("every")
        self.norms = norms.select("chunk", "slot", key, "section", norm.alias("norm")).where("norm > 0")

    def _saved(self, df: DataFrame, name: str) -> DataFrame:
        """Stored, and what was shuffled for it is dropped at once."""
        with set_for(self.spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
            return _stored(df, f"{self.root}/{name}")

    def _flat(self, wanted: DataFrame | None = None) -> DataFrame:
        """(section, word, chunk, slot, key, n) of all terms or of the wanted ones (word)."""
        columns = f"section string, word string, chunk long, slot long, {self.key} {self._kind}, n long"
        rows = self.chunks.select("chunk", "keys", "data")
        if wanted is None:
            rows = rows.withColumn("wanted", F.lit(None).cast("array<string>"))
        else:
            self._sets = getattr(self, "_sets", 0) + 1
            sets = -(-wanted.count() // WANTED)
            rows = rows.crossJoin(self._saved(wanted.groupBy(F.pmod(F.xxhash64("word"), F.lit(max(1, sets))).alias("set")).agg(F.collect_list("word").alias("wanted")).select("wanted"), f"wanted-{self._sets}"))
        return rows.mapInArrow(G.found(self.n, self.key, _arrow(columns)), columns)

    @property
    def counts(self) -> DataFrame:
        """(section, term, key, n) of all documents; a term is told by a 64-bit hash of its section and its word."""
        return self._flat().select("section", F.xxhash64("section", "word").alias("term"), self.key, "n")

    @property
    def vocabulary(self) -> DataFrame:
        """(section, term, word, df)."""
        return self._flat().select("section", "word").repartition(self.parts, "section", "word").groupBy("section", "word").agg(F.count("*").alias("df")).select("section", F.xxhash64("section", "word").alias("term"), "word", "df")

    def _tf(self, n: Column) -> Column:
        return 1 + F.log(n) if self.sublinear else n.cast("double")

    def _idf(self, df: Column) -> Column:
        """0 for a term of too few documents."""
        if not self.sizes:
            return F.lit(0.0)
        at = F.col("section")
        return F.when(df >= _map(self.least)[at], F.log((1 + _map(self.sizes)[at]) / (1 + df)) + 1).otherwise(0.0)

    def checked(self) -> TermIndex:
        """This index, or an error if no document has a term: there is nothing to compare with then."""
        if not self.sizes:
            raise ValueError("no document has terms: all are empty or hold stop words only")
        return self

    def drop(self) -> None:
        """Removes the tables."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def words(self) -> DataFrame:
        """(section, term, word, df, idf) of the vocabulary."""
        idf = F.log((1 + _map(self.sizes)[F.col("section")]) / (1 + F.col("df"))) + 1 if self.sizes else F.lit(0.0)
        return self.vocabulary.select("term", "section", "word", "df", idf.alias("idf"))

    def _shares(self, asked: DataFrame) -> DataFrame:
        """(item, chunk, slot, key, section, share) for all terms that a description and a document share, a document's in one
        task; they sum up to cosines. Descriptions, with their terms, are a stated set that is broadcast where it is small."""
        words = asked.select("item", F.explode_outer("terms").alias("word")).where("word IS NOT NULL").groupBy("item", "word").agg(F.count("*").alias("q_n"))
        each = words.select("item", "q_n", "word", F.explode(F.array(*map(F.lit, self.sizes)).cast("array<string>")).alias("section"))
        terms = each.select("item", "q_n", "section", F.xxhash64("section", "word").alias("term"))
        self._asked = getattr(self, "_asked", 0) + 1
        near = self._flat(words.select("word").distinct()).select("section", F.xxhash64("section", "word").alias("term"), "chunk", "slot", self.key, "n")
        near = self._saved(near, f"near-{self._asked}")
        idf = self._idf(F.col("df"))
        df = near.groupBy("term").agg(F.count("*").alias("df"))
        q = terms.join(df, "term").select("item", "section", "term", (self._tf(F.col("q_n")) * idf).alias("q"), idf.alias("idf")).where("q > 0")
        q = self._saved(q, f"asked-{self._asked}")
        lengths = q.groupBy("item", "section").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("length"))
        few = q.count() <= WANTED
        q = q.join(lengths, ["item", "section"]).select("item", "term", (F.col("q") * F.col("idf") / F.col("length")).alias("share"))
        # a document's postings meet its norms first; then what it shares with all descriptions is summed in one task
        norms = self.norms.repartition(self.parts, "chunk", "slot").groupBy("chunk", "slot").agg(F.map_from_entries(F.collect_list(F.struct("section", "norm"))).alias("norms"))
        own = near.select("chunk", "slot", self.key, "section", "term", self._tf(F.col("n")).alias("tf")).repartition(self.parts, "chunk", "slot").join(norms, ["chunk", "slot"])
        own = own.withColumn("norm", F.try_element_at("norms", F.col("section"))).where("norm IS NOT NULL").drop("norms")
        both = own.join(F.broadcast(q) if few else q, "term")
        return both.select("item", "chunk", "slot", self.key, "section", (F.col("tf") * F.col("share") / F.col("norm")).alias("share"))

    def cosines(self, asked: DataFrame) -> DataFrame:
        """(item, key, section, cos) for all descriptions (item, terms: array of 1- to n-grams) and all documents and sections that
        share a term that counts."""
        return self._shares(asked).groupBy("item", "chunk", "slot", self.key, "section").agg(F.sum("share").alias("cos")).select("item", self.key, "section", "cos")

    def similarities(self, asked: DataFrame, weights: dict[str, float]) -> DataFrame:
        """(item, key, similarity): cosines by section, weighed. A document that lacks a section scores 0 there; a section
        that no document has is left out of the weights."""
        used = {s: w for s, w in weights.items() if s in self.sizes}
        shares = self._shares(asked).where(F.col("section").isin(*used) if used else F.lit(False))
        share = _map(used)[F.col("section")] * F.col("share") / sum(used.values()) if used else F.lit(0.0)
        return shares.groupBy("item", "chunk", "slot", self.key).agg(F.sum(share).alias("similarity")).select(self.key, "item", "similarity")


def boosted(similarity: Column, overlap: Column, most: float = 0.5) -> Column:
    """Raised by up to a half with the share of wanted skills that are there, at most 1."""
    return F.least(similarity * (1 + most * overlap), F.lit(1.0))


def keyword_scores(tfidf: DataFrame, docs: DataFrame, asked: DataFrame, key: str, k: int, weights: tuple[float, float] = (0.7, 0.3)) -> DataFrame:
    """The `k` best documents of each description: item, key, tfidf, skill, final, rank, matched, missing.

    `tfidf` (item, key, similarity) has what shares a term, `docs` (key, skills) all documents and `asked` (item, skills)
    all descriptions. final is 0.7 tfidf + 0.3 of the share of the description's skills that a document has, within 0 and
    1; ranks are by final, then tfidf, both to 12 places (sums of equal terms may differ in the last), then key.

    Documents meet descriptions by a term or a skill that both have, not each with each; where fewer than `k` do, those
    with the least keys fill the ranks, with 0. Of documents with the same skills and no term those with the `k` least keys
    are enough, as any other has these `k` before it. Skills of documents are found once; matches are written out for the
    best only.
    """
    order = F.asc_nulls_last(key)
    named = asked.select("item", F.col("skills").alias("wanted"))
    own = _stored(docs.select(key, "skills"), f"{scratch_folder(docs.sparkSession)}/skills")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), own.count() // 4_000)
    least = own.withColumn("_n", F.row_number().over(Window.partitionBy("skills").orderBy(order))).where(F.col("_n") <= k).select(key, "skills")
    shared = least.select(key, F.explode("skills").alias("skill")).join(asked.select("item", F.explode("skills").alias("skill")), "skill").select("item", key)
    rest = asked.select("item").crossJoin(docs.select(key).orderBy(order).limit(k))
    zero = shared.unionByName(rest).withColumn("similarity", F.lit(0.0))
    pairs = tfidf.select("item", key, "similarity").unionByName(zero).repartition(parts, key).groupBy(key, "item").agg(F.sum("similarity").alias("tfidf"))
    rows = pairs.join(own.repartition(parts, key), key).join(named, "item")
    skill = F.when(F.size("wanted") > 0, F.size(F.array_intersect("wanted", "skills")) / F.size("wanted")).otherwise(0.0)
    final = F.greatest(F.lit(0.0), F.least(F.lit(1.0), weights[0] * F.col("tfidf") + weights[1] * F.col("skill")))
    rows = rows.withColumn("skill", skill).withColumn("final", final)
    best = F.row_number().over(Window.partitionBy("item").orderBy(F.round("final", 12).desc(), F.round("tfidf", 12).desc(), order))
    rows = rows.withColumn("rank", best.cast("long")).where(F.col("rank") <= k)
    hit, missing = F.array_sort(F.array_intersect("wanted", "skills")), F.array_sort(F.array_except("wanted", "skills"))
    return rows.select("item", key, "tfidf", "skill", "final", "rank", hit.alias("matched"), missing.alias("missing"))
