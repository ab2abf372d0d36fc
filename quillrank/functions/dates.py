"""Date ranges in texts and what follows from them; "today" is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillrank import config


def month_number(name: Column) -> Column:
    """1 to 12 by a month's first three letters; January if it is empty."""
    at = F.array_position(F.array(*map(F.lit, config.MONTHS)), F.substring(F.lower(name), 1, 3)).cast("int")
    return F.when(at > 0, at).otherwise(1)


def _date(year: Column, month: Column, day: int) -> Column:
    return F.to_date(F.try_to_timestamp(F.format_string(f"%s-%02d-{day:02d}", year, month), F.lit("yyyy-MM-dd")))


def ranges(text: Column, as_of: Column) -> Column:
    """(start, end, months) of every range. An open end is `as_of`; a bare year ends in December; years that are no
    dates are skipped, and an end before its start has 0 months."""
    part = lambda k: F.regexp_extract_all(text, F.lit(config.DATE_RANGE), F.lit(k))

    def one(x: Column) -> Column:
        end = F.lower(x["e"])
        year, name = F.regexp_extract(end, r"(\d{4})", 1), F.regexp_extract(end, r"^([a-z]+)", 1)
        until = F.when(end.isin("present", "current", "now"), as_of).when(name == "", _date(year, F.lit(12), 31)).otherwise(_date(year, month_number(name), 1))
        return F.struct(_date(x["y"], month_number(x["m"]), 1).alias("start"), until.alias("end"))

    zipped = F.arrays_zip(part(1).alias("m"), part(2).alias("y"), part(3).alias("e"))
    dated = F.filter(F.transform(zipped, one), lambda r: r["start"].isNotNull() & r["end"].isNotNull())
    return F.transform(dated, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), months(r["start"], r["end"]).alias("months")))


def months(start: Column, end: Column) -> Column:
    """Months from start to end, both included."""
    n = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start) + 1
    return F.when(end < start, 0).otherwise(n)


def recency(last: Column, as_of: Column) -> Column:
    """1 today, falling to 0 in 730 days; 0.5 if unknown. Dates ahead give more than 1."""
    return F.when(last.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), 1 - F.datediff(as_of, last) / 730.0))


def experience_score(years: Column, recent: Column) -> Column:
    return 0.7 * F.least(F.log1p(years) / F.log(F.lit(16.0)), F.lit(1.0)) + 0.3 * recent


def experience_depth(years: Column) -> Column:
    y = F.coalesce(years, F.lit(0.0))
    return F.round(F.when(y <= 0, 0.0).otherwise(F.least(F.least(y, F.lit(20.0)) / 10.0, F.lit(1.0))), 4)


def stability(roles: Column) -> Column:
    r = F.coalesce(roles, F.lit(0))
    return F.round(F.when(r <= 0, 1.0).otherwise(1.0 / (1.0 + r / 5.0)), 4)


def years(text: Column) -> Column:
    """All years from 1900 to 2099 that a text names, as numbers on their own, sorted and distinct."""
    found = F.regexp_extract_all(text, F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda y: y.cast("int"))))


def year_span(text: Column) -> Column:
    """(earliest, latest, years_min, years_max) of the years that a text names; all null if it names none."""
    y = years(text)
    first, last = F.array_min(y), F.array_max(y)
    return F.struct(first.alias("earliest"), last.alias("latest"), (last - first).alias("years_min"), (last - first).alias("years_max"))
