"""Nested records: skill maps, settings, taxonomies, entities, and rows that are known by a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.functions import entities as E
from quillrank.functions import text as X


def _last_of_each(entries: Column) -> Column:
    """A map of (key, value) entries: of equal keys the last."""
    kept = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(kept)


def implied_map(answer: Column) -> Column:
    """A model's answer as a map from skill to the skills that imply it, all lower case and without white space around.

    What isn't a list, and blank keys and values, are left out. An answer that holds no JSON object gives null.
    """
    parsed = F.from_json(X.json_object(answer), "map<string,string>")
    tidy = lambda x: X.strip(F.lower(x))
    entries = F.transform(
        F.filter(F.map_entries(parsed), lambda e: F.startswith(F.ltrim(e["value"]), F.lit("[")) & (tidy(e["key"]) != "")),
        lambda e: F.struct(tidy(e["key"]).alias("key"), F.filter(F.transform(F.from_json(e["value"], "array<string>"), tidy), lambda v: v != "").alias("value")),
    )
    return F.when(parsed.isNotNull(), X.once(entries, _last_of_each))


def map_status(answer: Column) -> Column:
    return F.when(answer.isNull(), "pending").when(implied_map(answer).isNull(), "failed").otherwise("ready")


def ready_map(status: Column, implied: Column) -> Column:
    """The map of a job whose map is ready, else an empty one."""
    return F.coalesce(F.when(status == "ready", implied), F.create_map().cast("map<string,array<string>>"))


def map_meta(implied: Column, description: Column) -> Column:
    """(skill_count, implied_skills_total, jd_word_count)."""
    total = F.aggregate(F.map_values(implied), F.lit(0), lambda n, v: n + F.size(v))
    return F.struct(F.size(F.map_keys(implied)).cast("long").alias("skill_count"), total.cast("long").alias("implied_skills_total"), X.word_count(description).cast("long").alias("jd_word_count"))


def updated(old: Column, new: Column) -> Column:
    """A map with another's entries over its own, one level deep."""
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))
    return F.map_concat(kept, new)


def taxonomy(text: Column) -> Column:
    """The skills of a taxonomy file: a list, or an object with `skills`, else `canonical_skills`; anything else is empty."""
    held = F.from_json(text, "skills array<string>, canonical_skills array<string>")
    own = F.when(F.startswith(F.ltrim(text), F.lit("[")), F.from_json(text, "array<string>"))
    return F.coalesce(own, held["skills"], held["canonical_skills"], F.array().cast("array<string>"))


def normalized_entities(skills: Column, roles: Column, organizations: Column, locations: Column, degree: Column) -> Column:
    """A record with every field in its canonical form; lists keep their order and what becomes equal stays."""
    entries = F.transform(skills, lambda s: F.struct(X.normalize_skill(s["skill"]).alias("key"), F.struct(s["count"].alias("count"), s["confidence"].alias("confidence")).alias("value")))
    return F.struct(
        X.once(entries, _last_of_each).alias("skills"), F.transform(roles, X.normalize_role).alias("roles"), F.transform(organizations, X.normalize_organization).alias("organizations"),
        F.transform(locations, X.normalize_role).alias("locations"), E.normalize_degree(degree).alias("degree"),
    )


def union_of(*lists: Column) -> Column:
    """Sorted distinct elements of several lists."""
    return F.array_sort(F.array_distinct(F.concat(*lists)))


def first_text(candidates: DataFrame, key: str, order: str, priority: list[str]) -> DataFrame:
    """Of each key the text of the first kind in `priority` that has one, stripped; keys without any text are left out."""
    at = F.array_position(F.array(*map(F.lit, priority)), F.col(order))
    some = candidates.withColumn("text", X.strip(F.col("text"))).where((F.length("text") > 0) & (at > 0))
    return some.groupBy(key).agg(F.min_by("text", at).alias("text"))


def by_file(entities: DataFrame, names: DataFrame) -> DataFrame:
    """Names with the entities that are kept under them (base, entities): the name as it is without a suffix .txt, or
    without its suffix, whichever is there first; null where none is."""
    spellings = F.array_distinct(F.array(F.regexp_replace("name", r"\.txt$", ""), F.regexp_replace("name", r"(?<=.)\.[^./]*$", ""), F.regexp_replace("name", r"(?<=.)\.[^./]*(\.txt)?$", "")))
    tried = names.select("name", F.posexplode(spellings).alias("nth", "base")).join(entities, "base", "left")
    return tried.groupBy("name").agg(F.min_by("entities", F.when(F.col("entities").isNotNull(), F.col("nth"))).alias("entities"))


def latest(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The last n rows of each owner (the limit is the feature)."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def corrected(rows: DataFrame, changes: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Rows with the changed columns of those that `changes` has; others keep their own."""
    new = changes.select(*key, *(F.col(c).alias(f"_{c}") for c in columns))
    out = rows.join(new, key, "left")
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*(f"_{c}" for c in columns))


def guarded(rows: DataFrame, column: str, company, state: str | None = None) -> DataFrame:
    """One company's rows; with `state`, those that aren't deleted."""
    own = rows.where(F.col(column) == company)
    return own.where(F.col(state) != "deleted") if state else own
