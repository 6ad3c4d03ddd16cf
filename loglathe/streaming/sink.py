"""An event table that batches are appended to, each once and whole.

``events`` and ``sessions`` hold a folder for each batch and in it one for each bucket of sessions, so a
batch looks for its rows' uids only in the buckets that it touches.  A batch writes its rows,
its sessions' first and last times, greatest number and cursor, and at last its commit: readers see
batches up to the last commit, so rows and cursors come together.  A batch that is run again replaces what it
wrote.  Batches come one after the other, as a stream's do.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loglathe.schema import PARSER_VERSION
from loglathe.sources.records import Source


@dataclass(frozen=True)
class EventSink:
    spark: SparkSession
    path: str
    buckets: int = 64

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col("session").cast("string")), F.lit(self.buckets)).cast("int")

    def _table(self, name: str, before: int) -> DataFrame | None:
        """Rows of the batches before one; None if there are none."""
        try:
            found = self.spark.read.option("mergeSchema", True).parquet(f"{self.path}/{name}")
        except AnalysisException:
            return None
        return found.where(F.col("batch") < before)

    def _end(self) -> int:
        """The first batch that isn't committed."""
        done = self._table("commits", 2**31 - 1)
        last = done.agg(F.max("batch")).first()[0] if done is not None else None
        return 0 if last is None else last + 1

    def events(self) -> DataFrame | None:
        found = self._table("events", self._end())
        return None if found is None else found.drop("batch", "bucket")

    def sessions(self) -> DataFrame | None:
        """(session, first_ts, last_ts, top, cursor, parser_version): what all committed batches say."""
        found = self._table("sessions", self._end())
        if found is None:
            return None
        newest = F.max_by(F.struct("cursor", "parser_version"), F.when(F.col("cursor").isNotNull(), F.col("batch")))
        out = found.groupBy("session").agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.max("top").alias("top"), newest.alias("c"))
        return out.select("session", "first_ts", "last_ts", "top", "c.cursor", "c.parser_version")

    def fresh(self, rows: DataFrame, batch_id: int, order: list[str]) -> DataFrame:
        """Rows (bucket, session, uid, ...) that no earlier batch has, each once, numbered on from their
        sessions' greatest number.  Rows with an empty uid are all new."""
        touched = [r[0] for r in rows.select("bucket").distinct().collect()]
        named = rows.where("uid <> ''").dropDuplicates(["session", "uid"]).unionByName(rows.where("uid = ''"))
        old, known = self._table("events", batch_id), self._table("sessions", batch_id)
        if old is not None:
            named = named.join(old.where(F.col("bucket").isin(touched)).where("uid <> ''").select("bucket", "session", "uid"), ["bucket", "session", "uid"], "left_anti")
        top = F.lit(-1)
        if known is not None:
            tops = known.where(F.col("bucket").isin(touched)).groupBy("session").agg(F.max("top").alias("top"))
            named, top = named.join(tops, "session", "left"), F.coalesce("top", F.lit(-1))
        return named.withColumn("seq", (F.row_number().over(Window.partitionBy("session").orderBy(*order)) + top).cast("long")).drop("top")

    def append(self, batch: DataFrame, batch_id: int, order: list[str], cursors: DataFrame | None = None) -> None:
        """Append ``batch`` (session, uid, ts, ...) with its ``cursors`` (session, cursor, parser_version).  A batch
        that is committed already changes nothing."""
        if batch_id < self._end():
            return
        rows = batch.drop("seq").withColumn("bucket", self._bucket()).persist()
        try:
            at = f"batch={batch_id}"
            self.fresh(rows, batch_id, order).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/events/{at}")
            kind = rows.schema["session"].dataType
            mine = self.spark.read.schema(f"session {kind.simpleString()}, ts timestamp, seq long").parquet(f"{self.path}/events/{at}") if rows.limit(1).count() else None
            spans = self.spark.createDataFrame([], f"session {kind.simpleString()}, first_ts timestamp, last_ts timestamp, top long")
            if mine is not None:
                spans = mine.groupBy("session").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max("seq").alias("top"))
            if cursors is None:
                told = spans.withColumns({"cursor": F.lit(None).cast("string"), "parser_version": F.lit(None).cast("int")})
            else:
                told = spans.join(cursors.select(F.col("session").cast(kind).alias("session"), "cursor", "parser_version"), "session", "full")
            told.select("session", "first_ts", "last_ts", "top", "cursor", "parser_version").withColumn("bucket", self._bucket()).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/sessions/{at}")
            self.spark.range(1).select(F.current_timestamp().alias("at")).write.mode("overwrite").parquet(f"{self.path}/commits/{at}")
        finally:
            rows.unpersist()


def catch_up(source: Source, sink: EventSink, order: list[str]) -> DataFrame:
    """Read what ``source`` has grown by since the sink's cursors, append it and its cursors as one batch,
    and give the files (path, error) that could not be read."""
    plan = source.plan(sink.sessions())
    stem = F.regexp_extract("path", r"([^/]+)\.jsonl$", 1)
    named = F.coalesce("session", stem) if "session" in plan.columns else stem
    cursors = plan.where("error is null").select(named.alias("session"), F.col("stop").cast("string").alias("cursor"), F.lit(PARSER_VERSION).alias("parser_version"))
    sink.append(source.events(plan), sink._end(), order, cursors)
    return plan.where("error is not null").select("path", "error")
