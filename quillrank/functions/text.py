"""Text functions from column to column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillrank import config


def once(value: Column, use) -> Column:
    """`use` of a value that is computed one time, however often a lambda in `use` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalize(text: Column, aliases: dict[str, str] = config.SKILL_ALIASES) -> Column:
    """Lower case, aliases, everything but letters, digits and _ as single spaces."""
    low = reduce(lambda t, a: F.replace(t, F.lit(a[0]), F.lit(a[1])), aliases.items(), F.lower(text))
    return F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}_]+", " "))


def extract_skills(text: Column, vocabulary: list[str]) -> Column:
    """Sorted skills of a text: single words by word, phrases wherever they occur in the normalised text."""
    words, phrases = [v for v in vocabulary if " " not in v], [v for v in vocabulary if " " in v]

    def find(norm: Column) -> Column:
        found = F.array_intersect(F.split(norm, " "), F.array(*map(F.lit, words)))
        if phrases:
            found = F.concat(found, F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(norm, p)))
        return F.array_sort(F.array_distinct(found))

    return once(normalize(text), find)


def slugify(name: Column) -> Column:
    """Lower case, blanks and underscores as dashes, nothing but letters, digits and dashes, no dash at the ends."""
    dashed = F.regexp_replace(strip(F.lower(name)), r"[\s_]+", "-")
    plain = F.regexp_replace(F.regexp_replace(dashed, "[^a-z0-9-]", ""), "-+", "-")
    return F.regexp_replace(plain, "^-|-$", "")


def sentences(text: Column) -> Column:
    """Cut after . ! ? and white space; blank sentences are dropped."""
    flat = F.replace(text, F.lit(".\n"), F.lit(". "))
    return F.filter(F.split(flat, r"(?<=[.!?])\s+"), lambda s: F.length(strip(s)) > 0)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("int")


def chunks(text: Column, target: float = 200, least: float = 20, per_word: float = 1.3) -> Column:
    """(t, w) of chunks: sentences packed greedily up to about `target` estimated tokens; those under `least` are
    dropped.

    A fold over the sentences' numbers of words keeps where chunks begin and end: one is closed before it would go over
    the target, and when it has reached it. Texts are put together once, at the end.
    """

    def pack(some: Column) -> Column:
        cut = lambda a, to: F.concat(a["out"], F.array(F.struct(a["at"].alias("at"), (to - a["at"]).alias("n"), a["w"].alias("w"))))
        none = F.array().cast("array<struct<at:int,n:int,w:int>>")

        def step(a: Column, s: Column) -> Column:
            over = (a["w"] > 0) & ((a["w"] + s["w"]) * per_word > target)
            out, at, w = F.when(over, cut(a, s["i"])).otherwise(a["out"]), F.when(over, s["i"]).otherwise(a["at"]), F.when(over, 0).otherwise(a["w"])
            full = (w + s["w"]) * per_word >= target
            now = F.struct(out.alias("out"), at.alias("at"), (w + s["w"]).alias("w"))
            return F.struct(
                F.when(full, cut(now, s["i"] + 1)).otherwise(out).alias("out"), F.when(full, s["i"] + 1).otherwise(at).alias("at"), F.when(full, 0).otherwise(w + s["w"]).alias("w"),
            )

        counted = F.transform(some, lambda s, i: F.struct(i.alias("i"), word_count(s).alias("w")))
        start = F.struct(none.alias("out"), F.lit(0).alias("at"), F.lit(0).alias("w"))
        cuts = F.aggregate(counted, start, step, lambda a: F.when(a["w"] > 0, cut(a, F.size(some))).otherwise(a["out"]))
        kept = F.filter(cuts, lambda c: c["w"] * per_word >= least)
        return F.transform(kept, lambda c: F.struct(F.array_join(F.slice(some, c["at"] + 1, c["n"]), " ").alias("t"), c["w"].alias("w")))

    return once(F.transform(sentences(text), strip), pack)


def char_windows(text: Column, size: int = 2000, overlap: int = 200) -> Column:
    """Windows of characters, each `size - overlap` further on, until one reaches the end."""
    n, stride = F.length(text), size - overlap
    count = F.greatest(F.ceil((n - overlap) / stride), F.lit(1)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct((i * stride).alias("start"), F.substr(text, i * stride + 1, F.lit(size)).alias("chunk")))).otherwise(F.array().cast("array<struct<start:int,chunk:string>>"))


def word_windows(text: Column, size: int = 307, overlap: int = 38) -> Column:
    """Windows of words, joined by single spaces."""
    stride = size - overlap

    def cut(words: Column) -> Column:
        count = F.greatest(F.ceil((F.size(words) - overlap) / stride), F.lit(1)).cast("int")
        each = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.array_join(F.slice(words, i * stride + 1, size), " "))
        return F.when(F.size(words) > 0, each).otherwise(F.array().cast("array<string>"))

    return once(F.filter(F.split(text, r"\s+"), lambda w: w != ""), cut)


def terms(text: Column, n: int = 1, stop: list[str] | None = None) -> Column:
    """All 1- to n-grams of the words of two characters or more that aren't stop words."""
    words = F.filter(F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " ")), " "), lambda w: F.length(w) > 1)
    if stop:
        words = F.filter(words, lambda w: ~w.isin(stop))
    return once(words, lambda ws: _grams(ws, n)) if n > 1 else words


def _grams(words: Column, n: int) -> Column:
    """All 1- to n-grams: each length is the one below it beside the words that follow."""
    out, longest = words, words
    for k in range(2, n + 1):
        pairs = F.zip_with(longest, F.slice(words, k, F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))
        longest = F.filter(pairs, lambda g: g.isNotNull())
        out = F.concat(out, longest)
    return out


def excerpt(text: Column, n: int = 300) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def user_prompt(question: Column, candidates: Column, skills: int = 5) -> Column:
    """The question after numbered blocks of candidates (filename, rank, score, skills, excerpt), with their first skills;
    what a candidate lacks has a default. Without candidates the question alone."""

    def block(c: Column, i: Column) -> Column:
        text = lambda x, other: F.coalesce(x.cast("string"), F.lit(other))
        first = F.array_join(F.slice(F.coalesce(c["skills"], F.array().cast("array<string>")), 1, skills), ", ")
        return F.format_string(config.PROMPT_BLOCK, i + 1, text(c["filename"], "unknown"), text(c["rank"], "N/A"), text(c["score"], "0.0"), first, text(c["excerpt"], ""))

    before, between, after = map(F.lit, config.PROMPT_PARTS)
    blocks = F.array_join(F.transform(candidates, block), "\n\n")
    return F.when(F.size(candidates) > 0, F.concat(before, blocks, between, question, after)).otherwise(question)


def normalize_skill(skill: Column) -> Column:
    """A known spelling's canonical form, else without a version at the end."""
    low = strip(F.lower(skill))
    known = F.create_map(*(F.lit(x) for kv in config.SKILL_NAMES.items() for x in kv))
    plain = strip(F.regexp_replace(F.regexp_replace(low, r"\s*\d+(\.\d+)*$", ""), r"\s+", " "))
    return F.coalesce(F.try_element_at(known, low), plain)


def normalize_organization(org: Column) -> Column:
    """Without a company suffix, a known name's canonical form, single spaces."""
    low = F.regexp_replace(strip(F.lower(org)), r"\s+(inc|llc|ltd|corp|corporation|company|co)\.?$", "")
    known = F.create_map(*(F.lit(x) for kv in config.ORG_NAMES.items() for x in kv))
    return F.coalesce(F.try_element_at(known, low), strip(F.regexp_replace(low, r"\s+", " ")))


def normalize_role(role: Column) -> Column:
    return strip(F.regexp_replace(strip(F.lower(role)), r"\s+", " "))


def education_tier(text: Column, tiers: dict[int, list[str]] = config.EDUCATION_TIERS) -> Column:
    """The highest tier with a keyword anywhere in the lower-cased text, and its keywords there."""
    low = F.lower(text)
    hit = {t: F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)) for t, words in tiers.items()}
    none = F.struct(F.lit(0).alias("tier"), F.array().cast("array<string>").alias("keywords"))
    out = none
    for t in sorted(hit):
        out = F.when(F.size(hit[t]) > 0, F.struct(F.lit(t).alias("tier"), hit[t].alias("keywords"))).otherwise(out)
    return out


def job_titles(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?i)\b({config.JOB_TITLES})\b"), F.lit(0))))


def sanitize_filename(name: Column) -> Column:
    """Slashes, backslashes, double dots and zero characters as underscores, without white space at the ends."""
    out = name
    for bad in ("/", "\\", "..", "\0"):
        out = F.replace(out, F.lit(bad), F.lit("_"))
    return strip(out)


def json_object(answer: Column) -> Column:
    """What a model's answer holds from the first { to the last }, without code fences around; else all of it."""
    bare = strip(F.regexp_replace(F.regexp_replace(strip(answer), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", ""))
    clean = F.when(F.startswith(strip(answer), F.lit("```")), bare).otherwise(strip(answer))
    return once(clean, lambda t: F.coalesce(F.nullif(F.regexp_extract(t, r"(?s)\{.*\}", 0), F.lit("")), t))


def failure(suffix: Column, message: Column) -> Column:
    """The reason of a failed file from its error's message."""
    return (
        F.when(F.contains(message, F.lit("Unsupported file type")), F.concat(F.lit("Unsupported format: "), suffix, F.lit(" (supported: .pdf, .docx, .txt)")))
        .when(F.contains(message, F.lit("Failed to extract text")), F.concat(F.lit("Extraction error: "), message))
        .when(F.contains(F.lower(message), F.lit("timeout")), F.concat(F.lit("Processing timeout: "), message))
        .otherwise(F.concat(F.lit("Processing failed: "), message))
    )


def percent(score: Column) -> Column:
    return F.format_string("%.2f%%", score.cast("double") * 100)
