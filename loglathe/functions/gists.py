"""What a row shows in one line: its gist and where that comes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglathe.functions.text import clip, flatten, preview
from loglathe.schema import OPENING, PROMPT_LIMIT, PROSE_LIMIT

UNLIMITED = 2**31 - 1


def prose_gist(text: Column) -> tuple[Column, Column]:
    """(gist, gist_src) of prose of block records: judged as written, opened as plain prose."""
    one = flatten(text)
    short = F.length(one) <= PROSE_LIMIT
    return F.when(short, one).otherwise(clip(flatten(preview(text)), OPENING)), F.when(short, "verbatim").otherwise("pending")


def with_gists(rows: DataFrame, fixed: Column, by_marks: bool) -> DataFrame:
    """``rows`` (kind, said) with ``gist`` and ``gist_src``.  A row with a ``fixed`` line, an array of text
    and limit, shows that.  Other prompts and prose show themselves if short, else their opening,
    to be condensed; ``by_marks``: prose is judged and prompts are shown without markdown marks.
    Each step is a column of its own, so that no text is flattened twice."""
    prompt = F.col("kind") == "prompt"
    rows = rows.withColumn("fixed_line", fixed).withColumn("judged", F.when(F.col("fixed_line").isNull(), flatten(preview("said") if by_marks else F.col("said"))))
    short = F.length("judged") <= F.when(prompt, PROMPT_LIMIT).otherwise(PROSE_LIMIT)
    rows = rows.withColumn("short", short)
    as_is = F.col("short") if by_marks else F.col("short") | prompt
    opening = F.col("judged") if by_marks else F.when(as_is, F.col("judged")).otherwise(flatten(preview("said")))
    rows = rows.withColumn("line", F.coalesce(flatten(F.col("fixed_line.text")), opening))
    limit = F.when(F.col("fixed_line").isNotNull(), F.col("fixed_line.most")).when(prompt, PROMPT_LIMIT if not by_marks else F.when(F.col("short"), PROMPT_LIMIT).otherwise(OPENING)).otherwise(F.when(F.col("short"), PROSE_LIMIT).otherwise(OPENING))
    src = F.when(F.col("fixed_line").isNotNull(), "rule").when(F.col("short"), "verbatim").otherwise("pending")
    return rows.withColumns({"gist": clip("line", limit.cast("int")), "gist_src": src}).drop("fixed_line", "judged", "short", "line")


def line(text: Column, most: int = 110) -> Column:
    """A fixed line for ``with_gists``."""
    return F.struct(text.alias("text"), F.lit(most).alias("most"))
