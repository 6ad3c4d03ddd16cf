"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

Sources in code point order (null last) weigh 1, 2, 3, 1, ...  They share ``share`` of all words by
weight, but none gets more than ``most_epochs`` times its own size.  With the sources sorted by
cap / weight, source i is clamped exactly if cap_i * (weight not yet clamped) <= weight_i * (words
not yet clamped); the rest share what is left by weight, which is where repeated resharing of the
excess ends.

A source of size S and target R takes each document floor(R / S) whole times.  The fraction left
is taken in a seeded order: documents fall into ``SLICES`` slices by a hash of seed and id; slices
below the cut are taken whole once more, and documents in the slice at the cut give the same part
of their words, rounded down at a seeded offset.  So a source's words are within a few of its
target, at any size, without sorting a source's documents in one task.

A row's text of any length is only counted; extra columns stay, whatever their names.  Nulls: a null
source is a source, a null text has no words, a null id hashes as an empty string.
Repeated rows are taken alike, each row on its own.  A source without words has target 0.  An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loglathe.llm.common import WORD, bounded_broadcast, read_table, stored

WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3
SLICES = 4096
SEED = "mix-1"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]++")), F.lit(0)).cast("long")


def _drawn(digit: int) -> Column:
    """32 seeded random bits of the id, from 8 of the hash's hexadecimal digits."""
    text = F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), digit, 8), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, slice, offset) of each row."""
    return docs.select("doc_id", "source", words_in(F.col("text")).alias("size")).select(
        "doc_id", "source", "size", (_drawn(1) % SLICES).alias("slice"), (_drawn(9) % 1_000_000).alias("offset")
    )


def targets(sizes: DataFrame, most_epochs: int = MOST_EPOCHS, share: float = 1.0) -> DataFrame:
    """(s_source, source_size, target) from rows (source, source_size): one row a source, so the
    windows over all of them hold no documents."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    every = Window.partitionBy()
    big = lambda c: F.col(c).cast("decimal(38,0)")
    s = sizes.withColumn("w", weight).withColumn("cap", most_epochs * F.col("source_size"))
    s = s.withColumns({"total": F.floor(F.sum("source_size").over(every) * F.lit(share)).cast("long"), "all_w": F.sum("w").over(every)})
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source").cast("binary")).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({"left_words": F.col("total") - F.coalesce(F.sum("cap").over(by_ratio), F.lit(0)), "left_w": F.col("all_w") - F.coalesce(F.sum("w").over(by_ratio), F.lit(0))})
    s = s.withColumn("clamped", big("cap") * big("left_w") <= big("w") * big("left_words"))
    s = s.withColumns({"rest": F.col("total") - F.coalesce(F.sum(F.when(F.col("clamped"), F.col("cap"))).over(every), F.lit(0)), "rest_w": F.sum(F.when(~F.col("clamped"), F.col("w"))).over(every)})
    target = F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(F.col("w").cast("double") * F.col("rest").cast("double") / F.col("rest_w").cast("double"))
    return s.select(F.col("source").alias("s_source"), "source_size", target.alias("target"))


def plan(rows: DataFrame) -> DataFrame:
    """One row a source: target, whole repetitions, the slice at the cut and the part taken of it."""
    slices = stored(rows.groupBy("source", "slice").agg(F.sum("size").alias("words")), "slices")
    t = targets(slices.groupBy("source").agg(F.sum("words").alias("source_size")))
    t = t.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    t = stored(t.withColumn("more", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    run = slices.join(bounded_broadcast(t, 100_000), F.col("source").eqNullSafe(F.col("s_source")))
    up_to = F.sum("words").over(Window.partitionBy("source").orderBy("slice"))
    run = run.withColumn("before", up_to - F.col("words")).where(F.col("before") <= F.col("more"))
    last = run.groupBy("source").agg(F.max("slice").alias("cut"), F.max("before").alias("before"))
    at = slices.select(F.col("source").alias("c_source"), F.col("slice").alias("cut"), F.col("words").alias("cut_words"))
    last = last.join(at, F.col("source").eqNullSafe(F.col("c_source")) & (last["cut"] == at["cut"])).select("c_source", last["cut"], "before", "cut_words")
    part = F.when(F.col("cut_words") > 0, F.least(F.lit(1.0), (F.col("more") - F.col("before")) / F.col("cut_words"))).otherwise(0.0)
    return t.join(last, F.col("s_source").eqNullSafe(F.col("c_source")), "left").select("s_source", "source_size", "target", "whole", "cut", part.alias("part"))


def mix(docs: DataFrame) -> DataFrame:
    """Every row with its size, its source's size and target, and the words that the mix takes."""
    rows = stored(sized(docs), "sizes")
    return _take(rows, plan(rows))


def _take(rows: DataFrame, planned: DataFrame) -> DataFrame:
    df = rows.join(bounded_broadcast(stored(planned, "mix-plan"), 100_000), F.col("source").eqNullSafe(F.col("s_source")), "left")
    at_cut = F.floor(F.col("size") * F.col("part") + F.col("offset") / 1_000_000).cast("long")
    more = F.when(F.col("slice") < F.col("cut"), F.col("size")).when(F.col("slice") == F.col("cut"), F.least(F.col("size"), at_cut)).otherwise(0)
    return df.withColumn("more_words", more).withColumn("taken", F.col("whole") * F.col("size") + F.col("more_words"))


def op7_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The mixture itself: each row once for each whole repetition that it gets, and once more if its
    slice is below the cut; rows in the slice at the cut come once more with the probability of the
    slice's part, by their seeded draw.  Rows of sources whose target is below their size can drop
    out."""
    names = docs.columns
    planned = bounded_broadcast(stored(plan(stored(sized(docs), "sizes")), "mix-plan"), 100_000)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id"), F.col("source"), words_in(F.col("text")).alias("size"))
    row = row.withColumns({"slice": _drawn(1) % SLICES, "offset": _drawn(9) % 1_000_000})
    out = row.join(planned, F.col("source").eqNullSafe(F.col("s_source")), "left")
    once_more = (F.col("slice") < F.col("cut")) | ((F.col("slice") == F.col("cut")) & (F.col("offset") < 1_000_000 * F.col("part")))
    times = (F.coalesce(F.col("whole"), F.lit(0)) + F.coalesce(once_more, F.lit(False)).cast("long")).cast("int")
    return out.where(times > 0).select("row", F.explode(F.sequence(F.lit(1), times)).alias("copy")).select("row.*")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: ``docs`` in the mixture's repetitions."""
    return mixed_rows(docs)
