"""Degrees, fields of study, roles, years and skills with confidence, by pattern."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillrank import config
from quillrank.functions import text as X


def _all(text: Column, patterns: list[str], clean) -> Column:
    """Sorted distinct matches of all patterns in either case."""
    found = F.concat(*(F.regexp_extract_all(text, F.lit(rf"(?i)\b(?:{p})\b"), F.lit(0)) for p in patterns))
    return F.array_sort(F.array_distinct(F.transform(found, clean)))


def _plain(x: Column) -> Column:
    return X.strip(F.regexp_replace(F.replace(F.lower(x), F.lit(".")), r"\s+", " "))


def degrees(text: Column) -> Column:
    """Degrees in lower case, without dots, with single spaces."""
    return _all(text, config.DEGREES, _plain)


def study_fields(text: Column) -> Column:
    return _all(text, config.STUDY_FIELDS, _plain)


def normalize_degree(degree: Column) -> Column:
    """Without dots, with single spaces, and with b or m and tech or sc as one word."""
    return F.regexp_replace(_plain(degree), r"\b([bm])\s*(tech|sc)\b", "$1$2")


def roles(text: Column, words: list[str] = config.ROLE_WORDS) -> Column:
    """Capitalised titles that hold a role word, in lower case, sorted and distinct."""
    found = F.concat(*(F.regexp_extract_all(text, F.lit(rf"\b(?:{p})\b"), F.lit(0)) for p in config.ROLE_PATTERNS))
    low = F.transform(found, lambda r: F.lower(F.regexp_replace(r, r"\s+", " ")))
    return F.array_sort(F.array_distinct(F.filter(low, lambda r: (F.length(r) > 3) & F.rlike(r, F.lit("|".join(words))))))


def title_roles(text: Column) -> Column:
    """A capitalised word of four characters or more and the role word after it, in lower case, sorted and distinct."""
    found = F.regexp_extract_all(text, F.lit(rf"\b[A-Z][a-z]{{3,}}\s+(?i:{'|'.join(config.TITLE_ENDS)})\b"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda r: F.lower(F.regexp_replace(r, r"\s+", " ")))))


def context_weight(text: Column) -> Column:
    """Sum of the weights of the contexts whose words occur in the text, or that of no context."""
    low = F.lower(text)
    hit = lambda words: F.rlike(low, F.lit("|".join(words)))
    total = sum((F.when(hit(words), w).otherwise(0.0) for words, w in config.CONTEXTS.values()), F.lit(0.0))
    return F.when(total > 0, total).otherwise(config.NO_CONTEXT)


def skill_mentions(text: Column, vocabulary: list[str]) -> Column:
    """(skill, count, confidence) of each skill of the vocabulary in the text, by skill: words by word, phrases wherever
    they occur, without overlap. Confidence is the share of all mentions times the context's weight. Null gives null."""
    words, phrases = [v for v in vocabulary if " " not in v], [v for v in vocabulary if " " in v]

    def count(norm: Column) -> Column:
        def tally(own: Column) -> Column:
            return F.transform(F.array_distinct(own), lambda s: F.struct(s.alias("skill"), F.size(F.filter(own, lambda x: x == s)).cast("long").alias("n")))

        out = X.once(F.filter(F.split(norm, " "), lambda w: w.isin(words)), tally)
        times = lambda p: F.call_function("div", F.length(norm) - F.length(F.replace(norm, p)), F.length(p)).cast("long")
        if phrases:
            long = F.transform(F.array(*map(F.lit, phrases)), lambda p: F.struct(p.alias("skill"), times(p).alias("n")))
            out = F.concat(out, F.filter(long, lambda s: s["n"] > 0))
        return F.array_sort(out)

    def weigh(found: Column) -> Column:
        total = F.aggregate(found, F.lit(0).cast("long"), lambda a, s: a + s["n"])
        return F.transform(found, lambda s: F.struct(s["skill"].alias("skill"), s["n"].alias("count"), F.round(s["n"] / total * context_weight(text), 4).alias("confidence")))

    return X.once(X.once(X.normalize(text), count), weigh)
