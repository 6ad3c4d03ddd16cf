"""Archive jobs: append, merge, export, retention, incremental reads."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loglathe.operators.pieces import running_sum
from loglathe.schema import SCHEMA_VERSION, require_version
from loglathe.scratch import new_path


def assign_seq(new: DataFrame, old: DataFrame, order: list[str]) -> DataFrame:
    """``new`` with dense numbers that go on from each session's greatest in ``old``."""
    top = old.groupBy("session").agg(F.max("seq").alias("top"))
    placed = running_sum(new, ["session"], order, F.lit(1), "place")
    return placed.join(top, "session", "left").withColumn("seq", F.col("place") + F.coalesce("top", F.lit(-1))).drop("top", "place")


def append_events(old: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """The rows to add to ``old``: those of ``new`` whose (session, uid) isn't there, each once
    (of rows alike in both, the earliest).
    Doing it again adds nothing."""
    once = F.row_number().over(Window.partitionBy("session", "uid").orderBy(*order))  # the earliest: rows are read twice, alike
    fresh = new.withColumn("nth", once).where("nth = 1").drop("nth").join(old.select("session", "uid"), ["session", "uid"], "left_anti")
    return assign_seq(fresh, old, order)


def merge_archive(ours: DataFrame, theirs: DataFrame, order: list[str]) -> DataFrame:
    """Both archives' events; ours win, theirs are numbered anew behind them."""
    return ours.unionByName(append_events(ours, theirs, order).select(*ours.columns))


def merge_seen(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Read marks never go back."""
    return ours.unionByName(theirs).groupBy("session").agg(F.max("seen").alias("seen"))


def shareable(events: DataFrame, raw: bool = False, strict: bool = False) -> DataFrame:
    """Events for others: without the text unless asked for, and strictly without the one-line
    forms of tool calls, which can hold a command."""
    out = events if raw else events.withColumn("raw", F.lit(""))
    return out.withColumn("gist", F.when(F.col("kind") == "tool", "").otherwise(F.col("gist"))) if strict else out


def changed_only(manifest: DataFrame, facts: DataFrame) -> DataFrame:
    """Files that have no facts yet as they are now."""
    return manifest.join(facts.select("path", "mtime", "bytes"), ["path", "mtime", "bytes"], "left_anti")


def stale(sessions: DataFrame, parser_version: int) -> DataFrame:
    """Sessions to read again, as an older parser wrote them."""
    return sessions.where(~F.col("parser_version").eqNullSafe(F.lit(parser_version)))


def retained(sessions: DataFrame, keep: int, days: int, most_bytes: int, as_of: Column) -> DataFrame:
    """Sessions that stay, in the order of ``rank``: what no live file can replace first, then the
    newest; of these the first ``keep``, no older than ``days``, and as many as fit ``most_bytes``.

    The ranks are global but only one task's running sums are: sessions are cut into ranges of
    (replaceable, day), the ranges' sums are carried over, and each range is ranked by itself."""
    rows = sessions.withColumn("rng", F.datediff(F.lit("2262-01-01").cast("date"), F.to_date("last_ts")) + F.col("replaceable").cast("int") * 1_000_000)

    def running(df: DataFrame, what: Column, name: str) -> DataFrame:
        inside = Window.partitionBy("rng").orderBy(F.desc("last_ts"), "id").rowsBetween(Window.unboundedPreceding, 0)
        before = Window.orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)
        total = df.groupBy("rng").agg(F.sum(what).alias("t")).select("rng", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("skip"))
        return df.join(total, "rng").withColumn(name, F.sum(what).over(inside) + F.col("skip")).drop("skip")

    ranked = running(rows, F.lit(1), "rank")
    young = ranked.where((F.col("rank") <= keep) & (F.col("last_ts") >= as_of - F.make_interval(days=F.lit(days))))
    return running(young, F.col("bytes"), "total").where(F.col("total") <= most_bytes).drop("rng")


def resume(manifest: DataFrame, sessions: DataFrame, parser_version: int) -> DataFrame:
    """Files to read, with ``start`` in bytes: the session's cursor, or 0 where there is none, where it
    isn't a number, where another parser wrote the session, and where the file has shrunk below it.
    Files without anything new are left out."""
    s = sessions.select("session", F.expr("try_cast(cursor AS BIGINT)").alias("at"), "parser_version")
    again = F.col("at").isNull() | (F.col("at") < 0) | (F.col("at") > F.col("bytes")) | ~F.col("parser_version").eqNullSafe(F.lit(parser_version))
    return manifest.join(s, "session", "left").withColumn("start", F.when(again, 0).otherwise(F.col("at"))).where(F.col("start") < F.col("bytes")).drop("at", "parser_version")


def reparsed(events: DataFrame, sessions: DataFrame, fresh: DataFrame, parser_version: int) -> DataFrame:
    """The archive's events where the rows of stale sessions are those of ``fresh``, read anew."""
    old = stale(sessions, parser_version).select(F.col("id").alias("session"))
    return events.join(old, "session", "left_anti").unionByName(fresh.join(old, "session", "left_semi").select(*events.columns))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col("session").cast("string")), F.lit(buckets)).cast("int")


def write_buckets(events: DataFrame, path: str, buckets: int) -> None:
    """The event table with a folder for each bucket of sessions."""
    events.withColumn("bucket", _bucket(buckets)).repartition(buckets, "bucket").write.partitionBy("bucket").parquet(path)


def rewrite_stale(spark: SparkSession, path: str, sessions: DataFrame, fresh: DataFrame, parser_version: int, buckets: int) -> None:
    """Put the rows of ``fresh`` in the place of stale sessions' in a table of ``write_buckets``.  Only the
    folders with stale sessions are read and written; their new rows are kept aside first, as a table
    can't be written while it is read."""
    old = stale(sessions, parser_version).select(F.col("id").alias("session")).withColumn("bucket", _bucket(buckets))
    touched = [r[0] for r in old.select("bucket").distinct().collect()]
    if not touched:
        return
    events = spark.read.parquet(path)
    kept = events.where(F.col("bucket").isin(touched)).join(old.select("session"), "session", "left_anti")
    new = fresh.join(old.select("session"), "session", "left_semi").withColumn("bucket", _bucket(buckets))
    aside = new_path(spark, "reparsed")
    kept.unionByName(new.select(*kept.columns)).repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(aside)
    rows = spark.read.schema(events.schema).parquet(aside)
    rows.repartition(len(touched), "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def described(manifest: DataFrame, facts: DataFrame, describe: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Facts of every file of ``manifest``: the kept ones where path, time and size are as they were,
    else ``describe`` of the changed files, which gives the columns of ``facts``."""
    key = ["path", "mtime", "bytes"]
    return facts.join(manifest.select(*key), key, "left_semi").unionByName(describe(changed_only(manifest, facts)).select(*facts.columns))


def load_events(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """All events of the sessions (session), in their order."""
    return events.join(sessions.select("session").distinct(), "session", "left_semi").orderBy("session", "seq")


def save_gists(answers: DataFrame, model: str, created: Column) -> DataFrame:
    """Rows for the append-only log of gists.  Nothing is updated: ``current_gists`` reads the newest
    of each hash, and events take gists by a join."""
    return answers.where(F.col("gist") != "").select("hash", "gist", F.lit(model).alias("model"), created.alias("created"), F.col("tok_in").cast("long").alias("tok_in"), F.col("tok_out").cast("long").alias("tok_out"))


def forgotten(hashes: DataFrame, created: Column) -> DataFrame:
    """Rows for the log that take the gists of (hash) back: their texts are pending again."""
    none = F.lit(None)
    return hashes.select("hash", none.cast("string").alias("gist"), none.cast("string").alias("model"), created.alias("created"), none.cast("long").alias("tok_in"), none.cast("long").alias("tok_out"))


def current_gists(log: DataFrame) -> DataFrame:
    """The newest gist of each hash in the append-only log; none of hashes that were forgotten since."""
    newest = F.struct("created", "gist", "model", "tok_in", "tok_out")
    return log.groupBy("hash").agg(F.max(newest).alias("g")).select("hash", "g.gist", "g.model", "g.created", "g.tok_in", "g.tok_out").where("gist is not null")


def merge_sessions(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Sessions of both; ours win, but a session that was read further elsewhere counts as read."""
    read = theirs.groupBy("id").agg(F.max("seen").alias("their_seen"))
    both = ours.join(read, "id", "left").withColumn("seen", F.greatest("seen", F.coalesce("their_seen", "seen"))).select(*ours.columns)
    new = theirs.dropDuplicates(["id"]).join(ours.select("id"), "id", "left_anti")
    return both.unionByName(new.select(*ours.columns))


def merge_gists(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    return ours.unionByName(theirs.dropDuplicates(["hash"]).join(ours.select("hash"), "hash", "left_anti").select(*ours.columns))


def merge_counts(ours: dict[str, DataFrame], theirs: dict[str, DataFrame]) -> DataFrame:
    """(name, rows) that a merge of ``sessions``, ``gists`` and ``events`` takes: merging again takes
    none."""
    keys = {"sessions": ["id"], "gists": ["hash"], "events": ["session", "uid"]}
    new = [theirs[t].select(*k).distinct().join(ours[t], k, "left_anti").agg(F.count("*").alias("rows")).select(F.lit(t).alias("name"), "rows") for t, k in keys.items()]
    return reduce(DataFrame.unionByName, new)


def shared_counts(sessions: DataFrame, gists: DataFrame, events: DataFrame) -> DataFrame:
    """(name, rows, raw_bytes) of what an export holds."""
    each = {"sessions": (sessions, F.lit(0)), "gists": (gists, F.lit(0)), "events": (events, F.coalesce(F.sum(F.octet_length("raw")), F.lit(0)))}
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("rows"), size.cast("long").alias("raw_bytes")).select(F.lit(t).alias("name"), "rows", "raw_bytes") for t, (df, size) in each.items()])


def export_archive(path: str, sessions: DataFrame, gists: DataFrame, events: DataFrame, raw: bool = False, strict: bool = False) -> dict[str, int]:
    """Write a copy for others below ``path``, with the schema's version; rows and bytes of text are
    counted while they are written."""
    out, seen = shareable(events, raw, strict), Observation("events")
    counts = {}
    for name, df in (("sessions", sessions), ("gists", gists)):
        n = Observation(name)
        df.withColumn("schema_version", F.lit(SCHEMA_VERSION)).observe(n, F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/{name}")
        counts[name] = n.get["n"]
    size = F.coalesce(F.sum(F.octet_length("raw")), F.lit(0)).alias("bytes")
    out.withColumn("schema_version", F.lit(SCHEMA_VERSION)).observe(seen, F.count(F.lit(1)).alias("n"), size).write.parquet(f"{path}/events")
    return counts | {"events": seen.get["n"], "raw_bytes": seen.get["bytes"]}


def read_archive(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of an archive; ValueError if a newer program wrote it."""
    return require_version(spark.read.option("mergeSchema", True).parquet(f"{path}/{name}")).drop("schema_version")


def archive_size(events: DataFrame) -> DataFrame:
    """(session, rows, bytes): what the archive holds of each session."""
    size = F.octet_length("raw") + F.octet_length(F.coalesce("gist", F.lit(""))) + F.octet_length(F.coalesce("outcome", F.lit("")))
    return events.groupBy("session").agg(F.count("*").alias("rows"), F.sum(size).cast("long").alias("bytes"))


def on_disk(spark: SparkSession, path: str) -> DataFrame:
    """(files, bytes) below a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def replaceable(sessions: DataFrame, manifest: DataFrame) -> DataFrame:
    """Sessions with ``replaceable``: whether their transcript is still there to be read again."""
    live = manifest.select("path").distinct().withColumn("replaceable", F.lit(True))
    return sessions.join(live, "path", "left").withColumn("replaceable", F.coalesce("replaceable", F.lit(False)))
