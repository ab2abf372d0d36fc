"""Sections of a text, found by their headings: words anywhere, or whole lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillrank import config
from quillrank.functions.text import strip

#: Marks set around headings; texts lose these two characters first.
OPEN, SHUT = "\x01", "\x02"
#: A line with capitals only, or with at most five words that each begin with one, under 50 characters.
OTHER_LINE = r"(?=[^\n]{1,49}$)(?:[^\p{Ll}\n]*\p{Lu}[^\p{Ll}\n]*|(?=\S+(?:[^\S\n]+\S+){0,4}$)[^\p{L}\n]*\p{Lu}\p{Ll}*(?:[^\p{L}\n]+\p{Lu}\p{Ll}*)*[^\p{L}\n]*)$"


def _cut(text: Column, heading: str) -> Column:
    """The text before the first heading, then a piece for each: the heading, a mark, what follows it."""
    clean = F.translate(F.coalesce(text, F.lit("")), OPEN + SHUT, "")
    return F.split(F.regexp_replace(clean, heading, f"{OPEN}$1{SHUT}"), OPEN)


def _family(heading: Column, families: dict[str, str], anchored: bool) -> Column:
    out = F.lit(None).cast("string")
    for name, words in reversed(families.items()):
        out = F.when(F.rlike(heading, F.lit(rf"(?i)^\s*(?:{words})" + ("" if anchored else "$"))), name).otherwise(out)
    return out


def _pieces(text: Column, heading: str, families: dict[str, str], lead: str, anchored: bool) -> Column:
    def one(piece: Column, i: Column) -> Column:
        title = F.substring_index(piece, SHUT, 1)
        body = F.when(i == 0, piece).otherwise(F.substr(piece, F.length(title) + 2))
        return F.struct(F.when(i == 0, lead).otherwise(_family(title, families, anchored)).alias("section"), strip(body).alias("text"))

    return F.filter(F.transform(_cut(text, heading), one), lambda s: F.length(s["text"]) > 0)


def anywhere(text: Column, families: dict[str, str] = config.SECTION_WORDS) -> Column:
    """(section, text) in order. A family's words open a section wherever they stand, inside words too; what comes
    before the first is `general`. Empty pieces are dropped; null gives none."""
    return _pieces(text, "(?i)(" + "|".join(families.values()) + ")", families, "general", False)


def by_lines(text: Column, families: dict[str, str] = config.SECTION_LINES) -> Column:
    """A map from section to its text. Lines that begin with a family's words open its section; other lines that look
    like headings end the one before, and what follows them is lost. The rest of a heading's line is dropped, several
    bodies of a section are joined by a blank line, and the lines before the first heading are `other`."""
    words = "|".join(families.values())
    heading = rf"(?m)^([^\S\n]*(?:(?i:{words})[^\n]*|{OTHER_LINE}))$"
    found = F.filter(_pieces(text, heading, families, "other", True), lambda s: s["section"].isNotNull())
    names = F.array_distinct(F.transform(found, lambda s: s["section"]))
    merged = lambda n: F.array_join(F.transform(F.filter(found, lambda s: s["section"] == n), lambda s: s["text"]), "\n\n")
    return F.map_from_arrays(names, F.transform(names, merged))
