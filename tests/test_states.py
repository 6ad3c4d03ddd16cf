"""Streams with timers and the appending sink, against plain folds of all rows."""

import datetime as dt
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_sources import agent, text, write

from loglathe.operators import archive
from loglathe.sources import records
from loglathe.streaming import sink as sinks
from loglathe.streaming import states

START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


@pytest.fixture(scope="module", autouse=True)
def timers(spark):
    states.with_timers(spark)


def run(spark, tmp_path, parts, schema, job, out_schema):
    """Each part is a segment; rows of nobody, far behind, move the watermark at the end."""
    for i, part in enumerate([*parts, *[[("nobody", f"z{d}", START + dt.timedelta(days=d), *parts[0][0][3:])] for d in (30, 60, 61)]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = job(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out_schema).parquet(str(tmp_path / "out")).where("session <> 'nobody'").collect()


def shuffled(rows, r, n=3, reach=6):
    """In segments of time; within ``reach`` rows the order is another."""
    rows = sorted(rows, key=lambda x: (x[2], x[1]))
    for i in range(0, len(rows), reach):
        part = rows[i : i + reach]
        r.shuffle(part)
        rows[i : i + reach] = part
    return [rows[i * len(rows) // n : (i + 1) * len(rows) // n] for i in range(n)]


def test_states_change_without_a_row(spark, tmp_path):
    r = random.Random(4)
    rows, at = [], START
    for i in range(60):
        at += dt.timedelta(seconds=r.choice([1, 50, 119, 120, 121, 200, 300, 301, 302, 400, 90_000]))
        rows.append((r.choice("ab"), f"u{i:02}", at, r.choice(["say", "prompt", "tool"])))
    got = run(spark, tmp_path, shuffled(rows, r, reach=1), "session string, uid string, ts timestamp, kind string", lambda s: states.state_changes(s, "10 seconds"), "session string, at timestamp, state string, awaiting boolean")
    want = []
    for s in "ab":
        mine = sorted(x for x in rows if x[0] == s)
        mine.sort(key=lambda x: x[2])
        now, speaker = None, None
        for i, (_, _, ts, kind) in enumerate(mine):
            speaker = kind if kind != "tool" else speaker
            end = mine[i + 1][2] if i + 1 < len(mine) else START + dt.timedelta(days=59)
            for quiet in (0, 120, 301, 86_400):
                if quiet and ts + dt.timedelta(seconds=quiet) >= end:
                    continue
                status = ("live" if quiet < 120 else "waiting" if speaker == "say" and quiet < 86_400 else "idle", speaker == "prompt" and quiet <= 300)
                if status != now:
                    want.append((s, ts + dt.timedelta(seconds=quiet), *status))
                now = status
    assert sorted((x.session, x.at.replace(tzinfo=dt.UTC), x.state, x.awaiting) for x in got) == sorted(want)
    assert {x[2] for x in want} == {"live", "waiting", "idle"}


def test_folding_of_shuffled_segments(spark, tmp_path):
    r = random.Random(7)
    rows = [(r.choice("ab"), f"u{i:03}", START + dt.timedelta(seconds=i), r.choice(["", "x", "y"]), r.random() < 0.5, r.random() < 0.5) for i in range(150)]
    schema = "session string, uid string, ts timestamp, call_id string, is_call boolean, is_error boolean"
    got = run(spark, tmp_path, shuffled(rows, r), schema, lambda s: states.folded(s, "1 minute", keep=1000), "session string, call_id string, call string, result string, kind string")
    open_, want = {}, []
    for s, u, _, c, is_call, err in sorted(rows, key=lambda x: (x[2], x[1])):
        if is_call:
            if c and (s, c) in open_:
                want.append((s, open_[s, c], None, "tool"))
            if c:
                open_[s, c] = u
            else:
                want.append((s, u, None, "tool"))
        elif c and (s, c) in open_:
            want.append((s, open_.pop((s, c)), u, "tool"))
        elif err:
            want.append((s, None, u, "fail"))
    want += [(s, u, None, "tool") for (s, _), u in open_.items()]
    assert sorted(map(repr, ((x.session, x.call, x.result, x.kind) for x in got))) == sorted(map(repr, want))


def test_state_is_kept_by_group_not_by_session(spark, tmp_path):
    """Each key of state costs several calls into it a batch; sessions may be any number."""
    schema = "session string, uid string, ts timestamp, call_id string, is_call boolean, is_error boolean"
    late = START + dt.timedelta(days=1)
    names = [None, *(f"s{i}" for i in range(999))]
    parts = [
        [(s, "a", START, "x", True, False) for s in names] + [("nobody", "z", late, "x", False, False)],
        [("nobody", "y", late + dt.timedelta(days=1), "x", False, False)],
        [(s, "b", late + dt.timedelta(days=2), "x", False, True) for s in names] + [("nobody", "w", late + dt.timedelta(days=9), "x", False, False)],
        [("nobody", "v", late + dt.timedelta(days=10), "x", False, False)],
    ]
    held = []
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = states.folded(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "1 minute", keep=10**6, groups=8)
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start()
        query.awaitTermination()
        held.append(max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress))
    assert 0 < max(held) < 100
    got = spark.read.schema("session string, call string, result string, kind string").parquet(str(tmp_path / "out")).collect()
    assert sorted((r.session or "", r.call, r.result, r.kind) for r in got) == sorted((s or "", "a", "b", "tool") for s in names)


class Held:
    """A value or list in state; as handle, the maker of these and of timers."""

    def __init__(self):
        self.value, self.timers = None, set()
        self.getListState = self.getValueState = lambda *_: Held()
        self.registerTimer, self.deleteTimer = self.timers.add, self.timers.remove

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value or []

    def update(self, value):
        self.value = value

    put = update

    def clear(self):
        self.value = None


def in_steps(job, rows, ends):
    """Results of one group whose rows come all at first, when time goes on in these steps."""
    handle = Held()
    job.init(handle)
    found, new = [], [pa.Table.from_pylist(rows, job.schema)]
    for end in ends:
        found += [x for f in job._advance(new, end) for x in f.astype(object).itertuples(index=False, name=None)]
        new = []
        assert all(t * 1000 > end for t in handle.timers)
    return sorted(map(repr, found)), handle.timers


@pytest.mark.parametrize("job", [states.Changes, lambda: states.Calls(400)], ids=["changes", "calls"])
def test_a_group_of_many_sessions_in_any_steps(job):
    """Steps end anywhere, also at a row's time or when something is due."""
    r = random.Random(11)
    rows = [{"session": f"s{r.randrange(200)}", "call_id": "c", "at": r.randrange(3000) * 10**6, "uid": f"u{i:04}", "kind": r.choice(["say", "prompt", "tool"]), "is_call": r.random() < 0.5, "is_error": r.random() < 0.5} for i in range(1500)]
    once, left = in_steps(job(), rows, [10**12])
    assert not left and len({x.split("'")[1] for x in once}) > 190
    for _ in range(3):
        ends = sorted({r.randrange(100_000) * 10**6 for _ in range(10)} | {x["at"] + 120_000_000 for x in rows[:20]} | {r.randrange(3000) * 10**6 for _ in range(30)})
        assert in_steps(job(), rows, [*ends, 10**12])[0] == once


def test_summaries_that_come_later_and_earlier(spark, tmp_path):
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    e, g = "session string, seq long, hash string, ts timestamp", "hash string, gist string, created timestamp"
    steps = [([("s", 0, "h0"), ("s", 1, "h1")], [("h9", "early")]), ([("s", 2, "h2"), ("s", 9, "h9")], []), ([("s", 3, "h0")], [("h0", "late"), ("h2", "same")])]
    for i, (events, gists) in enumerate(steps):
        now = START + dt.timedelta(hours=i)
        put("events", [(*x, now) for x in events], e)
        put("gists", [(*x, now) for x in gists] or [("none", "", now)], g)
        found = states.swept(spark.readStream.schema(e).parquet(str(tmp_path / "events")), spark.readStream.schema(g).parquet(str(tmp_path / "gists")))
        found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema("seq long, gist string").parquet(str(tmp_path / "out")).collect()
    assert sorted((r.seq, r.gist) for r in got) == [(0, "late"), (2, "same"), (3, "late"), (9, "early")]


def rows_of(spark, *rows):
    return spark.createDataFrame([(s, u, START + dt.timedelta(seconds=t), "x") for s, u, t in rows], "session string, uid string, ts timestamp, raw string")


def test_a_batch_is_appended_once_and_whole(spark, tmp_path):
    sink = sinks.EventSink(spark, str(tmp_path / "t"))
    order = ["ts", "uid"]
    told = lambda: sorted((r.session, r.uid, r.seq) for r in sink.events().collect())
    cursors = spark.createDataFrame([("s", "10", 1), ("quiet", "5", 1)], "session string, cursor string, parser_version int")
    sink.append(rows_of(spark, ("s", "a", 1), ("s", "b", 2), ("s", "b", 2), ("t", "a", 1), ("s", "", 3), ("s", "", 4)), 0, order, cursors)
    first = [("s", "", 2), ("s", "", 3), ("s", "a", 0), ("s", "b", 1), ("t", "a", 0)]
    assert told() == first
    sink.append(rows_of(spark, ("s", "zz", 1)), 0, order)  # committed already
    assert told() == first
    # rows without their commit are not there, and the batch can be run again
    sink.fresh(rows_of(spark, ("s", "c", 9)).withColumn("bucket", sink._bucket()), 1, order).write.partitionBy("bucket").parquet(str(tmp_path / "t/events/batch=1"))
    assert told() == first
    sink.append(rows_of(spark, ("s", "b", 2), ("s", "c", 5), ("u", "a", 1)), 1, order, cursors.where("session = 's'").withColumn("cursor", F.lit("20")))
    assert told() == sorted([*first, ("s", "c", 4), ("u", "a", 0)])
    sink.append(rows_of(spark).limit(0), 2, order)
    sink.append(rows_of(spark, ("s", "c", 5)), 3, order)
    assert told() == sorted([*first, ("s", "c", 4), ("u", "a", 0)])
    got = {r.session: (r.first_ts.second, r.last_ts.second, r.top, r.cursor) for r in sink.sessions().where("first_ts is not null").collect()}
    assert got == {"s": (1, 5, 4, "20"), "t": (1, 1, 0, None), "u": (1, 1, 0, None)}
    assert {r.session: r.cursor for r in sink.sessions().collect()}["quiet"] == "5"


def test_a_batch_reads_only_the_buckets_it_touches(spark, tmp_path):
    sink = sinks.EventSink(spark, str(tmp_path / "t"), buckets=16)
    sink.append(rows_of(spark, *[(f"s{i}", "a", i % 60) for i in range(200)]), 0, ["ts", "uid"])
    one = rows_of(spark, ("s7", "b", 1)).withColumn("bucket", sink._bucket())
    (bucket,) = [r.bucket for r in one.collect()]
    fresh = sink.fresh(one, 1, ["ts", "uid"])
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    read = [x for x in re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters", plan) if "bucket#" in x]
    assert len(read) >= 2 and all(re.search(rf"bucket#\d+ = {bucket}\)", x) for x in read)  # of events and sessions
    assert [(r.session, r.uid, r.seq) for r in fresh.collect()] == [("s7", "b", 1)]


def test_catching_up_with_files(spark, tmp_path):
    logs, sink = records.BlockLogs(spark, str(tmp_path / "logs")), sinks.EventSink(spark, str(tmp_path / "t"))
    one, two = agent(text("one"), uuid="a1"), agent(text("two"), uuid="a2")
    write(tmp_path, "logs/p/s.jsonl", one, tail='{"ty')
    assert sinks.catch_up(logs, sink, ["ts", "uid"]).count() == 0
    write(tmp_path, "logs/p/s.jsonl", one, two)
    sinks.catch_up(logs, sink, ["ts", "uid"])
    sinks.catch_up(logs, sink, ["ts", "uid"])
    assert [(r.uid, r.raw, r.seq) for r in sink.events().orderBy("seq").collect()] == [("a1", "one", 0), ("a2", "two", 1)]
    assert [(r.session, int(r.cursor)) for r in sink.sessions().collect()] == [("s", (tmp_path / "logs/p/s.jsonl").stat().st_size)]


def test_only_folders_with_stale_sessions_are_written_anew(spark, tmp_path):
    path = str(tmp_path / "events")
    events = spark.createDataFrame([(f"s{i}", f"u{j}", "old") for i in range(40) for j in range(3)], "session string, uid string, raw string")
    archive.write_buckets(events, path, 8)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "events").rglob("part-*.parquet")}
    sessions = spark.createDataFrame([(f"s{i}", 0 if i == 7 else 1) for i in range(40)], "id string, parser_version int")
    fresh = events.where("session IN ('s7', 's8')").withColumn("raw", F.lit("new"))
    archive.rewrite_stale(spark, path, sessions, fresh, 1, 8)
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "events").rglob("part-*.parquet")}
    same = [p for p in before if after.get(p) == before[p]]
    assert len({p.parent for p in before} - {p.parent for p in same}) == 1
    rows = spark.read.parquet(path).collect()
    assert len(rows) == 120 and {r.session for r in rows if r.raw == "new"} == {"s7"}


def test_gist_versions_and_forgetting(spark):
    at = lambda h: F.lit(f"2024-01-01 0{h}:00:00").cast("timestamp")
    answers = spark.createDataFrame([("h", "one", 1, 1), ("k", "two", 1, 1)], "hash string, gist string, tok_in long, tok_out long")
    log = archive.save_gists(answers, "m", at(1)).unionByName(archive.forgotten(answers.where("hash = 'h'").select("hash"), at(2)))
    assert [r.hash for r in archive.current_gists(log).collect()] == ["k"]
    again = log.unionByName(archive.save_gists(answers.withColumn("gist", F.lit("three")), "m", at(3)))
    assert sorted((r.hash, r.gist) for r in archive.current_gists(again).collect()) == [("h", "three"), ("k", "three")]
