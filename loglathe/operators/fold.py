"""Tool results folded into their calls, and the event table made of normalised rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loglathe.functions.identity import content_hash
from loglathe.schema import EVENTS, PARSER_VERSION


def paired(rows: DataFrame, order: list[str], by: tuple[str, ...] = ("file",)) -> DataFrame:
    """Calls and results (file, call_id, is_call, ...) with ``answer``, a struct of the row that follows
    a call if that is its result, and ``answers``: whether a result follows its call.  Rows with an
    empty id never pair, and are spread by their place."""
    key = F.when(F.col("call_id") == "", F.concat(F.lit("#"), F.xxhash64(*order).cast("string"))).otherwise(F.concat(F.lit("="), "call_id"))
    w = Window.partitionBy(*by, key).orderBy(*order)
    named = F.col("call_id") != ""
    row = F.struct(*[F.col(c) for c in rows.columns if c in ("raw", "hint", "body", "is_error")])
    return rows.withColumns({"answer": F.when(F.col("is_call") & named & ~F.lead("is_call").over(w), F.lead(row).over(w)), "answers": F.coalesce(~F.col("is_call") & named & F.lag("is_call").over(w), F.lit(False))})


def fold_results(rows: DataFrame, order: list[str]) -> DataFrame:
    """Calls with the body of the result that follows them as ``outcome``, and whether it failed."""
    return paired(rows, order).where("is_call").withColumns({"outcome": F.col("answer.body"), "failed": F.coalesce("answer.is_error", F.lit(False))}).drop("answer", "answers")


def orphan_failures(rows: DataFrame, order: list[str]) -> DataFrame:
    """Failed results whose call isn't there."""
    return paired(rows, order).where(~F.col("is_call") & ~F.col("answers") & F.col("is_error")).drop("answer", "answers")


def folded(rows: DataFrame, orphans: bool = True, by: tuple[str, ...] = ("file",)) -> DataFrame:
    """Normalised rows without results, in one pass: a call takes its result's text, hint and failure;
    a failed result without a call becomes a ``fail`` row if ``orphans``.  Rows that are neither
    never pair."""
    order = ["pos", "sub"]
    is_result = F.col("kind") == "result"
    pairs = rows.withColumn("call_id", F.when(is_result | F.col("is_call"), F.col("call_id")).otherwise(""))
    done = paired(pairs, order, by)
    lost = is_result & ~F.col("answers") & F.col("is_error") & F.lit(orphans)
    body = F.when(F.col("is_call"), F.coalesce("answer.raw", F.lit(""))).otherwise("")
    new = {
        "kind": F.when(is_result, "fail").otherwise(F.col("kind")),
        "raw": F.when(body == "", F.col("raw")).otherwise(F.concat("raw", F.lit("\n\n── result ──\n"), body)),
        "outcome": F.when(F.col("is_call"), F.col("answer.hint")).when(~is_result, F.col("hint")),
        "is_error": F.when(F.col("is_call"), F.coalesce("answer.is_error", F.lit(False))).otherwise(F.col("is_error")),
    }
    return done.where(~is_result | lost).select(*[c for c in rows.columns if c not in new], *[v.alias(k) for k, v in new.items()])


def events_of(rows: DataFrame, source: str, orphans: bool = True) -> DataFrame:
    """The event table of normalised rows: they are dealt by session once, and folding, removal of rows
    read twice and numbering all work on that."""
    return to_events(folded(rows.repartition("session"), orphans, ("session", "file")), source)


def to_events(rows: DataFrame, source: str) -> DataFrame:
    """Folded rows in the columns of ``schema.EVENTS``; ``seq`` is dense within a session, in the order
    of the log.  Rows of one session with one uid are the same row read twice: the first
    stays, but rows without a uid all do."""
    once = Window.partitionBy("session", "uid").orderBy("file", "pos", "sub")
    rows = rows.withColumn("n", F.row_number().over(once)).where("n = 1 or uid = ''")
    seq = F.row_number().over(Window.partitionBy("session").orderBy("file", "pos", "sub")) - 1
    new = {"source": F.lit(source), "seq": seq.cast("long"), "content_hash": content_hash(F.col("kind"), F.col("tool"), F.col("raw")), "parser_version": F.lit(PARSER_VERSION)}
    return rows.select(*[(new[c] if c in new else F.col(c)).alias(c) for c in (x.split()[0] for x in EVENTS.split(", "))])
