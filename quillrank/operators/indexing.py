"""From texts to index rows and processed records: validation, duplicates, sections, entities, experience and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank import config
from quillrank.functions import dates as D
from quillrank.functions import entities as E
from quillrank.functions import sections as S
from quillrank.functions import text as X
from quillrank.operators import records
from quillrank.sources.files import texts


def none() -> Column:
    return F.array().cast("array<string>")


def named_places(found: Column | None, least: int) -> Column:
    """What a model named, in lower case and stripped, of `least` characters or more, sorted and distinct."""
    low = F.transform(none() if found is None else found, lambda x: X.strip(F.lower(x)))
    return F.array_sort(F.array_distinct(F.filter(low, lambda x: F.length(x) >= least)))


def section_text(sections: Column, name: str) -> Column:
    """The first section of a name; null if there is none."""
    return F.get(F.filter(sections, lambda s: s["section"] == name), F.lit(0))["text"]


def chunked(sections: Column, text: Column) -> Column:
    """(chunk_idx, section, text, words) of all sections' chunks, numbered through; of the whole text as `general` if no
    section is long enough for one."""
    of = lambda name, t: F.transform(X.chunks(t), lambda c: F.struct(name.alias("section"), c["t"].alias("text"), c["w"].alias("words")))
    numbered = lambda cs: F.transform(cs, lambda c, i: F.struct(i.cast("long").alias("chunk_idx"), c["section"].alias("section"), c["text"].alias("text"), c["words"].alias("words")))
    every = F.flatten(F.transform(sections, lambda s: of(s["section"], s["text"])))
    return X.once(every, lambda cs: numbered(F.when(F.size(cs) > 0, cs).otherwise(of(F.lit("general"), text))))


def raw_skills(named: Column, text: Column, vocabulary: list[str]) -> Column:
    """Skills that a model named and those of the vocabulary, of two characters or more, sorted and distinct."""
    low = F.transform(named, lambda s: X.strip(F.lower(s)))
    return F.filter(records.union_of(low, X.extract_skills(text, vocabulary)), lambda s: F.length(s) > 1)


def experience(text: Column, as_of: Column) -> Column:
    """(entries, years, latest): all date ranges, their months together as years (40 at most), the latest end."""

    def sums(r: Column) -> Column:
        total = F.aggregate(r, F.lit(0), lambda n, x: n + x["months"])
        return F.struct(r.alias("entries"), F.round(F.least(total / 12.0, F.lit(40.0)), 2).alias("years"), F.array_max(F.transform(r, lambda x: x["end"])).alias("latest"))

    return X.once(D.ranges(text, as_of), sums)


def indexed(files: DataFrame, as_of: Column, vocabulary: list[str] = config.SKILLS, named: Column | None = None, organizations: Column | None = None, least: int = 100) -> DataFrame:
    """An index row for each of `files` (company, job, candidate, text, error), with its status and reason.

    A file with an error, or a text under `least` characters, fails; of a job's equal texts all but the one with the least
    candidate are duplicates, found by the least candidate of each hash before anything is joined; the rest is processed.
    `named` and `organizations` are arrays that a model of the caller's found. Rows that aren't processed have no index
    fields.
    """
    text = X.strip(F.coalesce("text", F.lit("")))
    rows = files.select("company", "job", "candidate", text.alias("text"), "error", (none() if named is None else named).alias("named"), (none() if organizations is None else organizations).alias("organizations"))
    short = F.concat(F.lit("text_extraction: Extracted text too short ("), F.length("text").cast("string"), F.lit(" chars)"))
    reason = F.when(F.col("error").isNotNull(), F.substring(F.concat(F.lit("text_extraction: "), F.col("error")), 1, 2000)).when(F.length("text") < least, short)
    rows = rows.withColumns({"reason": reason, "content_hash": F.when(reason.isNull(), F.sha2("text", 256))})
    first = rows.where("reason IS NULL").groupBy("job", "content_hash").agg(F.min("candidate").alias("first"))
    rows = rows.join(first, ["job", "content_hash"], "left")
    status = F.when(F.col("reason").isNotNull(), "failed").when(F.col("candidate") != F.col("first"), "duplicate").otherwise("processed")
    rows = rows.withColumn("status", status)
    done = F.col("status") == "processed"
    rows = rows.withColumn("sections", F.when(done, S.anywhere(F.col("text"))))
    of = lambda name: F.coalesce(section_text(F.col("sections"), name), F.col("text"))
    fields = {
        "extracted_skills": raw_skills(F.col("named"), F.col("text"), vocabulary),
        "organizations": F.array_sort(F.array_distinct(F.col("organizations"))),
        "job_titles": X.job_titles(F.col("text")),
        "experience": experience(of("experience"), as_of),
        "education": X.education_tier(of("education")),
        "chunks": chunked(F.col("sections"), F.col("text")),
    }
    return rows.select("company", "job", "candidate", "status", "reason", "content_hash", "sections", *(F.when(done, c).alias(n) for n, c in fields.items()))


def intelligence(text: Column, vocabulary: list[str] = config.SKILLS, named_roles: Column | None = None, organizations: Column | None = None, locations: Column | None = None) -> Column:
    """(sections, entities, experience) of a text: sections by heading lines, normalised entities of rules and of what a
    model of the caller's found (organisations of three characters or more, places of two), and signals of experience."""
    held = S.by_lines(text)
    names = [*config.SECTION_LINES, "other"]
    sections = X.once(held, lambda m: F.struct(*(F.coalesce(F.try_element_at(m, F.lit(n)), F.lit("")).alias(n) for n in names)))
    roles = records.union_of(E.roles(text), E.title_roles(text), none() if named_roles is None else named_roles)
    degree = F.get(E.degrees(text), F.lit(0))
    entities = records.normalized_entities(E.skill_mentions(text, vocabulary), roles, named_places(organizations, 3), named_places(locations, 2), degree)
    field = F.get(E.study_fields(text), F.lit(0)).alias("field")
    span = D.year_span(text)
    signals = lambda s, n: F.struct(
        D.experience_depth(s["years_max"].cast("double")).alias("experience_depth"), D.stability(n).alias("stability"), n.alias("role_count"),
        *(s[c].alias(c) for c in ("years_min", "years_max", "earliest", "latest")),
    )
    return F.struct(sections.alias("sections"), entities.alias("entities"), field, X.once(span, lambda s: signals(s, F.size(roles))).alias("experience"))


def processed(files: DataFrame) -> DataFrame:
    """(name, text, status, reason, duplicate_of) of files (name, text, error): FAILED with a reason by its error, EMPTY,
    DUPLICATE of the first name with the same text, or OK."""
    empty = F.length(X.strip(F.coalesce("text", F.lit("")))) == 0
    kind = F.when(F.col("error").isNotNull(), "FAILED").when(empty, "EMPTY")
    rows = files.select("name", "text", "error", kind.alias("kind"), F.when(kind.isNull(), F.sha2("text", 256)).alias("h"))
    first = rows.where("kind IS NULL").groupBy("h").agg(F.min("name").alias("first"))
    rows = rows.join(first, "h", "left")
    again = F.col("first") != F.col("name")
    status = F.when(F.col("kind").isNotNull(), F.col("kind")).when(again, "DUPLICATE").otherwise("OK")
    suffix = F.regexp_extract("name", r"\.[^./]*$", 0)
    reason = F.when(F.col("kind") == "FAILED", X.failure(suffix, F.col("error"))).when(F.col("kind") == "EMPTY", "Validation failed").when(again, F.concat(F.lit("Duplicate of "), F.col("first")))
    return rows.select("name", "text", status.alias("status"), reason.alias("reason"), F.when(status == "DUPLICATE", F.col("first")).alias("duplicate_of"))


def processing_stats(rows: DataFrame) -> DataFrame:
    """(total_files, ok, failed, empty, duplicate) of processed files."""
    of = lambda s: F.count_if(F.col("status") == s).alias(s.lower())
    return rows.agg(F.count("*").alias("total_files"), *map(of, ("OK", "FAILED", "EMPTY", "DUPLICATE")))


def write_processed(files: DataFrame, path: str, vocabulary: list[str] = config.SKILLS, readers: dict | None = None) -> DataFrame:
    """Process files (name, content) and write what they give, in tables below `path`: `texts` (name, text), `sections`,
    `entities` and `experience` (name and the fields) of the OK ones, `validation` (name, status, reason, chars) of all and
    `duplicates` (name, duplicate_of). Gives `validation` as it was written.

    Files are read once, texts are written before anything is made of them, and only a hash of a text is shuffled.
    """
    spark = files.sparkSession

    def saved(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    rows = saved(processed(saved(texts(files, readers), "read")), "processed")
    fine = saved(rows.where("status = 'OK'").select("name", "text"), "texts")
    found = saved(fine.select("name", intelligence(F.col("text"), vocabulary).alias("i")), "intelligence")
    saved(found.select("name", "i.sections.*"), "sections")
    saved(found.select("name", "i.entities.*", "i.field"), "entities")
    saved(found.select("name", "i.experience.*"), "experience")
    saved(rows.where("status = 'DUPLICATE'").select("name", "duplicate_of"), "duplicates")
    return saved(rows.select("name", "status", "reason", F.length("text").cast("long").alias("chars")), "validation")
