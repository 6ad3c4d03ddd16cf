"""Long sessions in pieces give what one window over each session gives."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loglathe.operators import archive, feed, sessions
from loglathe.operators.pieces import next_value, running_sum

ORDER = ["ts", "uid"]


def table(spark, n=1500):
    """One session with most rows over many hours, a null session, null and equal times."""
    r = random.Random(5)
    rows = []
    for i in range(n):
        ts = None if i % 97 == 0 else datetime(2024, 1, 1) + timedelta(minutes=r.randrange(6000) // 7 * 7)
        rows.append((r.choice(["big"] * 8 + ["small", None]), i, ts, r.choices(["say", "tool", "prompt", "note", "fail"], [50, 30, 2, 2, 6])[0], "t%d" % i, i % 5))
    return spark.createDataFrame(rows, "session string, uid long, ts timestamp, kind string, raw string, tokens long").repartition(3)


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    names = sorted(a.columns)
    assert sorted(map(repr, a.select(*names).collect())) == sorted(map(repr, b.select(*names).collect()))


def test_sums_and_next_values(spark):
    events = table(spark)
    for order in (ORDER, ["uid"], ["raw"]):
        w = Window.partitionBy("session").orderBy(*order)
        same(running_sum(events, ["session"], order, F.col("tokens"), "x"), events.withColumn("x", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))))
        rare = F.when(F.col("kind") == "note", F.col("raw"))
        same(next_value(events, ["session"], order, rare, "x"), events.withColumn("x", F.first(rare, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))))
    assert running_sum(events.limit(0), ["session"], ORDER, F.lit(1), "x").count() == 0


def test_neighbours_of_hits(spark):
    events = table(spark)
    w = Window.partitionBy("session").orderBy(*ORDER).rowsBetween(-12, 12)
    hit = F.col("kind") == "note"
    same(feed.near(events, hit, ORDER), events.withColumn("h", F.max(hit.cast("int")).over(w)).where("h = 1").drop("h"))
    assert feed.near(events, F.lit(False), ORDER).count() == 0


def test_numbers_go_on(spark):
    events = table(spark)
    old = spark.createDataFrame([("big", 41), ("big", 7)], "session string, seq long")
    found = archive.assign_seq(events, old, ORDER).groupBy("session").agg(F.min("seq"), F.max("seq"), F.countDistinct("seq"), F.count("*")).collect()
    for session, low, high, distinct, n in found:
        assert low == (42 if session == "big" else 0) and high == low + n - 1 and distinct == n


def test_feed_rows_of_events(spark):
    events = table(spark).where("session IS NOT NULL")
    rows = sorted(events.collect(), key=lambda r: (r.session, r.ts is not None, r.ts or datetime.min, r.uid))
    expect = {}
    for session in {r.session for r in rows}:
        own, run, last = [r for r in rows if r.session == session], 0, {}
        runs = []
        for r in own:
            run += r.kind in ("prompt", "note")
            runs.append(run)
            if r.kind == "say":
                last[run] = r.uid
        after = None
        for r, run in zip(reversed(own), reversed(runs), strict=True):
            if r.kind in ("prompt", "fail") or r.kind == "say" and last[run] == r.uid:
                after = r.uid
            expect[r.uid] = last[run] if r.kind == "say" else after
    assert {r.uid: r.row for r in sessions.shown_at(events, ["prompt", "fail"], ORDER).collect()} == expect


def test_a_session_is_many_windows(spark):
    events = table(spark)
    plan = feed.runs(events, ORDER)._jdf.queryExecution().optimizedPlan().toString()
    wide = [line for line in plan.splitlines() if "Window" in line and "raw" in line]
    assert all("_piece" in line for line in wide)
    assert "session" in plan
