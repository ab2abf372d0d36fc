"""A caller's columns kept apart from an operator's own, whatever they are called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, **own: Column) -> DataFrame:
    """All columns of `df` in one struct `row`, and beside it the columns that the operator works on."""
    return df.select(F.struct(*map(quoted, df.columns)).alias("row"), *(c.alias(n) for n, c in own.items()))


def unpacked(df: DataFrame, columns: list[str], **own: Column) -> DataFrame:
    """The caller's `columns` again, then the operator's; a column of the caller's with such a name gives way."""
    taken = {n.lower() for n in own}
    return df.select(*(F.col("row").getField(c).alias(c) for c in columns if c.lower() not in taken), *(c.alias(n) for n, c in own.items()))
