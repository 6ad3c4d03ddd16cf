"""Streams over the event log in three segments of time, each against the SQL of its batch twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglathe.functions.identity import content_hash
from loglathe.plans.registry import _GISTS, _HASH, AS_OF, _gists, query
from loglathe.scratch import new_path
from loglathe.sources.views import as_of, conversation_events, log_events
from loglathe.streaming import jobs, states
from loglathe.streaming.sink import EventSink


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_events(spark, sf_dir).select("session", "uid", F.col("ts").cast("timestamp").alias("ts"), "kind")


@query("SELECT session, uid, kind, seq FROM ev_seq")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each segment comes twice, the second time with the whole first segment again; the sink appends
    each row once, and numbers go on from batch to batch."""
    parts = jobs.cut(_rows(spark, sf_dir))
    again = [parts[0], *[p.unionByName(p).unionByName(parts[0]) for p in parts[1:]]]
    found: dict[str, EventSink] = {}

    def run(stream: DataFrame, out: str, marks: str) -> None:
        sink = found.setdefault(out, EventSink(spark, out, buckets=4))
        put = lambda batch, i: sink.append(batch.withColumn("at", F.col("uid")).withColumn("uid", F.col("uid").cast("string")), i, ["ts", "at"])
        stream.writeStream.foreachBatch(put).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()

    out = jobs.replayed(again, run, "dedup")
    events = found[out].events()
    if events is None:
        return spark.createDataFrame([], "session long, uid long, kind string, seq long")
    return events.select("session", F.col("uid").cast("long").alias("uid"), "kind", "seq")


@query("SELECT DISTINCT session, uid FROM ev_log")
def stream_dedup_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows repeated within their segment pass once, by state that the watermark ends."""
    parts = [p.unionByName(p) for p in jobs.cut(_rows(spark, sf_dir))]
    out = jobs.replayed(parts, lambda s, out, marks: jobs.appended(jobs.deduplicated(s, "30 days"), out, marks), "dedup-watermark")
    return spark.read.parquet(out).select("session", "uid")


@query("SELECT session, count(*) AS unread FROM ev_log WHERE kind IN ('prompt', 'say', 'fail') AND ts > TIMESTAMP '2024-01-05' + to_days(CAST(session % 20 AS INTEGER)) GROUP BY session")
def stream_unread(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    seen = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-05 00:00:00")) + (F.col("session") % 20) * 86400)
    marks = rows.select("session").distinct().withColumn("seen", seen)
    count = lambda batch, batch_id: jobs.unread_counts(batch, marks)
    out = jobs.replayed(jobs.cut(rows), lambda s, out, at: jobs.in_batches(s, out, at, count), "unread")
    return jobs.summed(spark, out)


@query(", b AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 20 SECOND THEN 0 ELSE 1 END AS new FROM ev_log WINDOW w AS (PARTITION BY session ORDER BY ts)), g AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM b) SELECT session, min(ts) AS started, max(ts) + INTERVAL 20 SECOND AS settled, count(*) AS n FROM g GROUP BY session, burst")
def stream_settle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of no session, a day after the last, and one more move the watermark past every burst."""
    rows = _rows(spark, sf_dir)
    later = lambda days: rows.agg(F.max("ts").alias("m")).where("m is not null").select(F.lit(-1).cast("long").alias("session"), F.lit(-1).cast("long").alias("uid"), (F.col("m") + F.make_interval(days=F.lit(days))).alias("ts"), F.lit("say").alias("kind"))
    out = jobs.replayed([*jobs.cut(rows), later(1), later(2)], lambda s, out, marks: jobs.appended(jobs.settled_turns(s), out, marks), "settle")
    found = spark.read.schema("session long, started timestamp, settled timestamp, n long").parquet(out).where("session <> -1")
    return found.select("session", F.col("started").cast("timestamp_ntz").alias("started"), F.col("settled").cast("timestamp_ntz").alias("settled"), "n")


_LATER = (45, 46)


def _shuffled(rows: DataFrame) -> list[DataFrame]:
    """Segments whose rows come in another order.  Rows of no session, days after the last, move the watermark past
    all others: one ends the last segment, and one comes alone, for sessions that run no batch without rows.  A
    stream's batch costs its tasks' starts and commits whatever it carries, so there are no more of them."""
    *parts, last = [p.orderBy(F.xxhash64("uid")) for p in jobs.cut(rows)]
    end, *later = _later(rows)
    return [*parts, last.unionByName(end), *later]


def _later(rows: DataFrame) -> list[DataFrame]:
    """A row of no session for each of these days after the last."""
    last = rows.agg(F.max("ts").alias("m")).where("m is not null")
    other = {"session": F.lit(-1).cast("long"), "uid": F.lit(-1).cast("long")}
    fill = {c: F.lit(None).cast(rows.schema[c].dataType) for c in rows.columns if c not in (*other, "ts")} | {c: F.lit("") for c in ("call_id", "kind")} | {c: F.lit(False) for c in ("is_call", "is_error")}
    return [last.select(*[(F.col("m") + F.make_interval(days=F.lit(d))).alias("ts") if c == "ts" else (other | fill)[c].alias(c) for c in rows.columns]) for d in _LATER]


def _folded(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Calls and failures of a stream whose rows come in another order within their segments."""
    states.with_timers(spark)
    out = jobs.replayed(_shuffled(rows), lambda s, out, marks: jobs.appended(states.folded(s, "1 day", keep=40 * 86_400), out, marks), "fold")
    found = spark.read.schema(states.Calls.out).parquet(out).where("NOT session <=> '-1'")
    return found.select(F.col("session").cast("long").alias("session"), "call_id", F.col("call").cast("long").alias("call"), F.col("result").cast("long").alias("result"), "kind")


def _tools(spark: SparkSession, sf_dir: str, call_id: Column) -> DataFrame:
    rows = _rows(spark, sf_dir).where(F.col("kind").isin("tool", "fail"))
    is_call = F.col("kind") == "tool"
    return rows.select("session", call_id.alias("call_id"), "uid", "ts", is_call.alias("is_call"), (~is_call).alias("is_error"))


@query(", p AS (SELECT session, uid, kind, lead(kind) OVER w AS nk, lead(uid) OVER w AS nu FROM ev_log WHERE kind IN ('tool', 'fail') WINDOW w AS (PARTITION BY session ORDER BY ts, CAST(uid AS VARCHAR))) SELECT session, uid AS call, nu AS result FROM p WHERE kind = 'tool' AND nk = 'fail'")
def stream_fold_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One id a session, again and again."""
    return _folded(spark, _tools(spark, sf_dir, F.lit("c"))).where("call is not null and result is not null").select("session", "call", "result")


@query(", p AS (SELECT session, uid, kind, uid % 7 AS c, lead(kind) OVER w AS nk, lead(uid) OVER w AS nu, lag(kind) OVER w AS bk FROM ev_log WHERE kind IN ('tool', 'fail') WINDOW w AS (PARTITION BY session, uid % 7 ORDER BY ts, CAST(uid AS VARCHAR))) SELECT session, CAST(c AS VARCHAR) AS call_id, CASE WHEN kind = 'tool' THEN uid END AS call, CASE WHEN kind = 'fail' THEN uid WHEN nk = 'fail' THEN nu END AS result, kind FROM p WHERE kind = 'tool' OR coalesce(bk, 'fail') = 'fail'")
def stream_fold_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven calls of a session in flight at once; calls without a result and failures without a call
    are rows too."""
    return _folded(spark, _tools(spark, sf_dir, (F.col("uid") % 7).cast("string")))


_STATUS = "CASE WHEN quiet < 120 THEN 'live' WHEN speaker = 'say' AND quiet < 86400 THEN 'waiting' ELSE 'idle' END AS state, coalesce(speaker = 'prompt' AND quiet < 301, false) AS awaiting"


@query(f""", told AS (SELECT session, ts, lead(ts) OVER w AS next_ts, last_value(CASE WHEN kind IN ('say', 'prompt') THEN kind END IGNORE NULLS) OVER w AS speaker, row_number() OVER w AS n FROM ev_log WINDOW w AS (PARTITION BY session ORDER BY ts, CAST(uid AS VARCHAR))),
 instants AS (SELECT session, speaker, n, quiet, ts + to_seconds(quiet) AS moment, next_ts FROM (SELECT *, unnest([0, 120, 301, 86400]) AS quiet FROM told)),
 known AS (SELECT session, n, quiet, moment, {_STATUS} FROM instants WHERE quiet = 0 OR next_ts IS NULL OR moment < next_ts),
 changes AS (SELECT *, lag(state) OVER w IS DISTINCT FROM state OR lag(awaiting) OVER w IS DISTINCT FROM awaiting AS new FROM known WINDOW w AS (PARTITION BY session ORDER BY n, quiet)) SELECT session, moment AS at, state, awaiting FROM changes WHERE new""")
def stream_state_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of a session's state, also those that come of quiet alone."""
    states.with_timers(spark)
    rows = _rows(spark, sf_dir)
    out = jobs.replayed(_shuffled(rows), lambda s, out, marks: jobs.appended(states.state_changes(s, "1 day"), out, marks), "changes")
    found = spark.read.schema("session string, at timestamp, state string, awaiting boolean").parquet(out).where("NOT session <=> '-1'")
    return found.select(F.col("session").cast("long").alias("session"), F.col("at").cast("timestamp_ntz").alias("at"), "state", "awaiting")


@query(f", g AS (SELECT session, min(ts) AS first_ts, max(ts) AS last_ts, arg_max(kind, (ts, uid)) FILTER (kind IN ('say', 'prompt')) AS last_speaker FROM ev_log GROUP BY session), q AS (SELECT *, CAST(floor(epoch({AS_OF})) AS BIGINT) - CAST(floor(epoch(last_ts)) AS BIGINT) AS quiet FROM g) SELECT session, first_ts, last_ts, last_speaker, CASE WHEN quiet < 120 THEN 'live' WHEN last_speaker = 'say' AND quiet < 86400 THEN 'waiting' ELSE 'idle' END AS state, coalesce(quiet <= 300 AND last_speaker = 'prompt', false) AS awaiting FROM q")
def stream_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jobs.replayed(jobs.cut(_rows(spark, sf_dir)), lambda s, out, marks: jobs.in_batches(s, out, marks, jobs.last_words), "states")
    found = jobs.live_states(spark, out, as_of())
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_ts", "last_ts")})


@query(_GISTS + f" SELECT session, seq, gist FROM (SELECT *, {_HASH} AS hash FROM ev_conv) LEFT JOIN gists USING (hash)")
def stream_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments by turn; the summaries of a segment's texts come a segment later, those of the last at the
    same time.  Every event takes its summary all the same."""
    e = conversation_events(spark, sf_dir)
    n = 3
    at = F.timestamp_seconds(F.unix_timestamp(as_of()) + F.pmod("seq", F.lit(n)) * 60)
    rows = e.select("session", "seq", content_hash(F.col("kind"), F.lit(None).cast("string"), F.col("raw")).alias("hash"), at.alias("ts"))
    first = rows.groupBy("hash").agg(F.min(F.pmod("seq", F.lit(n))).alias("part"))
    gists = _gists(spark, sf_dir).select("hash", "gist").join(first, "hash").withColumn("part", F.least(F.col("part") + 1, F.lit(n - 1)))
    gists = gists.withColumn("created", F.timestamp_seconds(F.unix_timestamp(as_of()) + F.col("part") * 60))
    folder, late, out, marks = (new_path(spark, f"sweep-{x}") for x in ("events", "gists", "table", "marks"))
    for i in range(n):
        rows.where(F.pmod("seq", F.lit(n)) == i).write.mode("append").parquet(folder)
        gists.where(F.col("part") == i).select("hash", "gist", "created").write.mode("append").parquet(late)
        found = states.swept(jobs.segments(spark, folder, rows.schema), jobs.segments(spark, late, gists.drop("part").schema))
        jobs.appended(found.select("session", "seq", "gist"), out, marks)
    updates = spark.read.schema("session long, seq long, gist string").parquet(out)
    return rows.select("session", F.col("seq").cast("long").alias("seq")).join(updates, ["session", "seq"], "left")
