"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each document gets integer measures (per mille of symbols, of repeated lines, of repeated words;
mean word length in hundredths).  A sketch is a histogram over log-linear integer buckets (exact
below 64, then 32 buckets for each power of two, so a quantile is off by at most 1/32).  Counts of
equal buckets add up, so sketches merge: Spark builds them by partial aggregation per language
and source, and the same rows summed again give the sketch of a language and of the whole corpus,
which stand in for a (language, source) with fewer than ``min_rows`` documents.

A document is rejected when a measure lies outside Tukey's outer fence of its own sketch,
q75 + ``reach`` * max(q75 - q25, slack) (below q25 likewise for the word length).  Slack keeps
uniform sources from rejecting at the first deviation.

Nulls: a null text has no words and fails the base rules; null languages and sources are groups
of their own.  Repeated rows are judged one by one; ties don't matter, as no row is ranked.  A very long text
is measured whole, in memory in proportion to its words.  Extra columns stay, whatever their
names.  An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loglathe.llm.common import BATCH_BYTES, bounded_broadcast, read_table, small_batches, stored, utf8, window_hashes

#: Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEATED_PERCENT, GRAM = 10, 20, 5
_SPACE = b" \t\n\x0b\x0c\r"
_NOT_A_START = bytes(range(0x80, 0xC0))


@dataclass(frozen=True)
class Params:
    reach: int = 3
    min_rows: int = 50
    #: Least interquartile range that counts, per measure.
    slack_symbols: int = 20
    slack_lines: int = 130
    slack_repeats: int = 70
    slack_length: int = 120

    def slack(self) -> dict[str, int]:
        return {"symbols": self.slack_symbols, "lines": self.slack_lines, "repeats": self.slack_repeats, "length": self.slack_length}


MEASURES = ("symbols", "lines", "repeats", "length")


def repeated_words(words: list[bytes], k: int = GRAM) -> int:
    """Words inside ``k``-word windows that occur at least twice in the text."""
    n = len(words) - k + 1
    if n < 2:
        return 0
    grams = window_hashes(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64), k)
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int32)
    starts = np.flatnonzero(twice)
    edge[starts] += 1
    edge[starts + k] -= 1
    return int(np.count_nonzero(np.cumsum(edge)))


def text_measures(data: bytes) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines with a word."""
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (
        len(words),
        len(data.translate(None, _SPACE + _NOT_A_START)),
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
    )


_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _structs(texts: pa.Array) -> pa.Array:
    rows = [text_measures(x.as_py()) for x in texts]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(_NAMES))], list(_NAMES))


def measures_of(text: Column) -> Column:
    """A struct of the measures of a binary text column."""
    return F.arrow_udf(_structs, "struct<" + ", ".join(f"{c}: bigint" for c in _NAMES) + ">")(text)


def judged_measures(m: str) -> dict[str, Column]:
    """base_failed and the four scaled measures, from a struct column of text measures."""
    v = lambda c: F.col(f"{m}.{c}")
    per = lambda k, top, bottom: F.when(v(bottom) > 0, F.expr(f"{k} * {m}.{top} div {m}.{bottom}")).otherwise(F.lit(0).cast("long"))
    return {
        "base_failed": (v("n_words") < MIN_WORDS) | (100 * v("n_repeat_words") > MAX_REPEATED_PERCENT * v("n_words")),
        "symbols": per(1000, "n_symbols", "word_chars"),
        "lines": per(1000, "n_dup_lines", "n_lines"),
        "repeats": per(1000, "n_repeat_words", "n_words"),
        "length": per(100, "word_chars", "n_words"),
    }


def measure(docs: DataFrame) -> DataFrame:
    """Id, language, source and measures of each row, without its text."""
    small_batches(docs.sparkSession)
    df = docs.select("doc_id", F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), measures_of(utf8("text")).alias("m"))
    return df.select("doc_id", "g_lang", "g_source", *[f"m.{c}" for c in _NAMES], *[c.alias(k) for k, c in judged_measures("m").items()])


_BITS = "length(bin(v))"
#: Bucket b of a non-negative integer v, and the largest value in bucket b.
BUCKET = f"CASE WHEN v < 64 THEN v ELSE 32 * ({_BITS} - 5) + shiftright(v, {_BITS} - 6) - 32 END"
TOP_OF = "CASE WHEN b < 64 THEN b ELSE shiftleft(b % 32 + 33, CAST(b div 32 - 1 AS INT)) - 1 END"


def sketches(measured: DataFrame) -> DataFrame:
    """Rows (g_lang, g_source, m, b, c): counts by bucket of each measure."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).alias("v")) for m in MEASURES])).alias("x")
    rows = measured.select("g_lang", "g_source", each).select("g_lang", "g_source", "x.m", "x.v")
    return rows.withColumn("b", F.expr(BUCKET).cast("long")).groupBy("g_lang", "g_source", "m", "b").agg(F.count("*").alias("c"))


def quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Rows, q25 and q75 of each measure for each group of ``by``, from sketches merged to it."""
    merged = sketch.groupBy(*by, "m", "b").agg(F.sum("c").alias("c"))
    w = Window.partitionBy(*by, "m")
    run = merged.withColumns({"n": F.sum("c").over(w), "below": F.sum("c").over(w.orderBy("b")), "top": F.expr(TOP_OF)})
    at = lambda p: F.min(F.when(100 * F.col("below") >= p * F.col("n"), F.col("top")))
    wide = run.groupBy(*by, "m").agg(F.max("n").alias("n"), at(25).alias("lo"), at(75).alias("hi"))
    pick = lambda m, c: F.max(F.when(F.col("m") == m, F.col(c)))
    return wide.groupBy(*by).agg(F.max("n").alias("n_docs"), *[pick(m, c).alias(f"{m}_{c}") for m in MEASURES for c in ("lo", "hi")])


def thresholds(sketch: DataFrame, p: Params) -> DataFrame:
    """One row for each (g_lang, g_source): the fences of its own sketch, or of its language's, or
    of the corpus."""
    own = quantiles(sketch, ["g_lang", "g_source"])
    lang = quantiles(sketch, ["g_lang"])
    every = quantiles(sketch.withColumn("one", F.lit(1)), ["one"])
    cols = [f"{m}_{c}" for m in MEASURES for c in ("lo", "hi")]
    lang = lang.select(F.col("g_lang").alias("l_lang"), F.col("n_docs").alias("l_n"), *[F.col(c).alias(f"l_{c}") for c in cols])
    every = every.select(*[F.col(c).alias(f"e_{c}") for c in cols], "one")
    df = own.withColumn("one", F.lit(1)).join(lang, F.col("g_lang").eqNullSafe(F.col("l_lang"))).join(F.broadcast(every), "one")
    best = {c: F.when(F.col("n_docs") >= p.min_rows, F.col(c)).when(F.col("l_n") >= p.min_rows, F.col(f"l_{c}")).otherwise(F.col(f"e_{c}")) for c in cols}
    fence = {}
    for m in MEASURES:
        spread = p.reach * F.greatest(best[f"{m}_hi"] - best[f"{m}_lo"], F.lit(p.slack()[m]))
        fence[f"max_{m}"] = best[f"{m}_hi"] + spread
        fence[f"min_{m}"] = best[f"{m}_lo"] - spread
    return df.select(F.col("g_lang").alias("t_lang"), F.col("g_source").alias("t_source"), *[c.alias(k) for k, c in fence.items() if k in ("max_symbols", "max_lines", "max_repeats", "max_length", "min_length")])


def _own() -> Column:
    """Joins a row to its fences."""
    return F.col("g_lang").eqNullSafe(F.col("t_lang")) & F.col("g_source").eqNullSafe(F.col("t_source"))


def _inside() -> Column:
    under = lambda m: F.col(m) <= F.col(f"max_{m}")
    return under("symbols") & under("lines") & under("repeats") & F.col("length").between(F.col("min_length"), F.col("max_length"))


def fences(measured: DataFrame, p: Params) -> DataFrame:
    return bounded_broadcast(stored(thresholds(sketches(measured), p), "fences"), 100_000)


def judge(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Every row's id and measures, with ``base_failed`` and ``kept``."""
    measured = stored(measure(docs), "quality")
    return measured.join(fences(measured, p), _own(), "left").withColumn("kept", ~F.col("base_failed") & F.coalesce(_inside(), F.lit(False)))


def kept_rows(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, in all their columns.  The texts are measured
    again beside the fences instead of being shuffled to the verdicts."""
    names = docs.columns
    limits = fences(measure(docs), p)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), measures_of(utf8("text")).alias("m"))
    row = row.withColumns(judged_measures("m")).where(~F.col("base_failed"))
    return row.join(limits, _own(), "left").where(_inside()).select("row.*")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the first: documents that the rules reject go.  All stages share the executors, so
    their batches are smaller than those of an operator alone."""
    small_batches(spark, BATCH_BYTES // 4)
    return kept_rows(docs)
