"""Streams over immutable segments of the log, each with the result of its batch twin.

Sinks write each micro-batch to a folder of its own, ``batch=<id>``: a batch that is run again after a
failure replaces what it wrote, and a reader never sees a table being rewritten.  State ends with the
watermark; what has no end (counts, last speakers) is kept in the sink and merged when it is read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglathe.operators.analytics import session_state
from loglathe.scratch import new_path


def segments(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """A stream of the Parquet segments in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def appended(stream: DataFrame, out: str, marks: str) -> None:
    """Run an appending stream over the segments that are there into a table; its checkpoint commits
    rows and position together."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def in_batches(stream: DataFrame, out: str, marks: str, shape: Callable[[DataFrame, int], DataFrame] | None = None) -> None:
    """The same, each batch through ``shape`` into its own folder."""

    def put(batch: DataFrame, batch_id: int) -> None:
        rows = shape(batch, batch_id) if shape else batch
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()


def replayed(rows: Iterable[DataFrame], run: Callable[[DataFrame, str, str], None], name: str) -> str:
    """Write ``rows`` segment by segment and let ``run(stream, out, marks)`` take up each from its
    checkpoint.  Gives ``out``."""
    out = marks = folder = ""
    for part in rows:
        spark = part.sparkSession
        if not out:
            folder, out, marks = (new_path(spark, f"{name}-{x}") for x in ("segments", "table", "marks"))
        part.write.mode("append").parquet(folder)
        run(segments(spark, folder, part.schema), out, marks)
    return out


def cut(rows: DataFrame, n: int = 3) -> list[DataFrame]:
    """``rows`` (ts) in ``n`` segments of equal time; nulls go with the first."""
    lo, hi = rows.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    if lo is None:
        return [rows]
    at = F.coalesce(F.floor((F.unix_micros("ts") - lo) * n / (hi - lo + 1)), F.lit(0))
    return [rows.where(at == i) for i in range(n)]


def deduplicated(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Repeated rows are harmless: each (session, uid) passes once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["session", "uid"])


def settled_turns(events: DataFrame, quiet: str = "20 seconds", late: str = "1 minute") -> DataFrame:
    """Bursts of a session that ``quiet`` has ended, with their rows: each comes once, when the
    watermark has passed its end, and its state goes."""
    g = events.withWatermark("ts", late).groupBy("session", F.session_window("ts", quiet).alias("w")).agg(F.count("*").alias("n"))
    return g.select("session", F.col("w.start").alias("started"), F.col("w.end").alias("settled"), "n")


def unread_counts(batch: DataFrame, marks: DataFrame) -> DataFrame:
    """(session, unread) of one batch: shown rows after the session's read mark (session, seen)."""
    shown = batch.where(F.col("kind").isin("prompt", "say", "fail")).join(marks, "session").where(F.col("ts") > F.col("seen"))
    return shown.groupBy("session").agg(F.count("*").alias("unread"))


def summed(spark: SparkSession, out: str) -> DataFrame:
    """The counts of all batches."""
    return spark.read.schema("session long, unread long").parquet(out).groupBy("session").agg(F.sum("unread").alias("unread"))


def last_words(batch: DataFrame, batch_id: int = 0) -> DataFrame:
    """(session, uid, ts, kind) of one batch: the rows that can decide a session's state, which are its
    first and last one and the last that somebody said."""
    at = F.struct("ts", "uid", "kind")
    said = F.when(F.col("kind").isin("say", "prompt"), at)
    g = batch.groupBy("session").agg(F.min(at).alias("a"), F.max(at).alias("b"), F.max(said).alias("c"))
    return g.select("session", F.explode(F.array_distinct(F.array("a", "b", "c"))).alias("x")).where("x is not null").select("session", "x.uid", "x.ts", "x.kind")


def live_states(spark: SparkSession, out: str, as_of: Column) -> DataFrame:
    """Each session's state at ``as_of``, from what ``last_words`` kept of all batches: sessions grow
    quiet without a row, so a state is judged when it is asked for."""
    return session_state(spark.read.schema("session long, uid long, ts timestamp, kind string").parquet(out), as_of)
