"""Chat examples by prefix-target expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn ", "</turn>\n"


def escape(text: Column) -> Column:
    """Texts without `<` and `"`, so that none can hold a mark of the template; `unescape` turns it back exactly."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("&quot;"), F.lit('"')), F.lit("&lt;"), F.lit("<"))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def expand(turns: DataFrame, target_role: str = "assistant") -> DataFrame:
    """Every assistant turn as its own example: all turns before it as context, only its text trainable.

    `turns` has conv_id, turn, role, text; more columns are left out. Turns are ordered by turn (null last), then
    role and text; repeated rows are repeated turns, a null text or role is empty, and rows without conv_id are one
    conversation. A conversation whose last turn is not the assistant's gets one more example with an empty mask, so
    that no turn is lost. No turns give no examples. Returns conv_id, example (0, 1, ...), is_last, formatted, and the mask [loss_start,
    loss_end) in code points of `formatted`.

    Prefixes come from a running window: the rows of a conversation stream through a task that spills, and what must
    fit in memory is one example, which by definition holds the whole conversation before it.
    """
    order = [F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    by = Window.partitionBy("conv_id").orderBy(*order)
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = F.concat(F.lit(f'{OPEN}"'), escape(F.col("role")), F.lit('">'))
    body = escape(F.col("text"))
    marked = turns.select(
        "conv_id", "turn", "role", "text",
        F.coalesce(F.col("role") == target_role, F.lit(False)).alias("_target"),
        F.concat(head, body, F.lit(CLOSE)).alias("_turn"),
        F.length(body).alias("_body"),
    )
    # 1 on the last row only
    last = F.lead(F.lit(0), 1, 1).over(by) == 1
    run = marked.select(
        "conv_id", "_target", "_body", last.alias("is_last"),
        F.collect_list("_turn").over(upto).alias("_turns"),
        F.sum(F.col("_target").cast("long")).over(upto).alias("_nth"),
    )
    shown = run.where(F.col("_target") | F.col("is_last")).withColumn("formatted", F.array_join("_turns", ""))
    end = F.length("formatted").cast("long") - len(CLOSE)
    return shown.select(
        "conv_id",
        (F.col("_nth") - F.when(F.col("_target"), 1).otherwise(0)).alias("example"),
        "is_last", "formatted",
        F.when(F.col("_target"), end - F.col("_body")).otherwise(F.length("formatted").cast("long")).alias("loss_start"),
        F.when(F.col("_target"), end).otherwise(F.length("formatted").cast("long")).alias("loss_end"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of an example as an array of (role, text), unescaped."""
    parts = F.filter(F.split(formatted, CLOSE), lambda x: x != "")
    head = len(OPEN) + 1
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.substring_index(F.substring(p, head + 1, 1 << 30), '">', 1)).alias("role"),
            unescape(F.substr(p, F.instr(p, '">') + 2)).alias("text"),
        ),
    )


def loss_text(example: DataFrame) -> Column:
    """What stands under the mask, unescaped."""
    start = F.col("loss_start").cast("int")
    return unescape(F.substr(F.col("formatted"), start + 1, (F.col("loss_end") - F.col("loss_start")).cast("int")))


def digest(examples: DataFrame) -> DataFrame:
    """Each conversation read back from its examples: all turns from the longest, the trainable text from every mask."""
    turns = F.when(F.col("is_last"), read_turns(F.col("formatted")))
    read = examples.select(
        "conv_id",
        F.struct("example", loss_text(examples).alias("text")).alias("loss"),
        F.length("formatted").cast("long").alias("chars"),
        F.size(turns).cast("long").alias("n"),
        F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("sha"),
        "is_last",
    )
    whole = read.groupBy("conv_id").agg(
        F.max(F.when(F.col("is_last"), F.col("n"))).alias("n_turns"),
        F.max(F.when(F.col("is_last"), F.col("sha"))).alias("turns_sha256"),
        F.array_join(F.transform(F.array_sort(F.collect_list("loss")), lambda x: x["text"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    return whole.select(
        "conv_id", "n_turns", "turns_sha256",
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
