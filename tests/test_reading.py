"""Reading only what is new, the ends of files, growing files, and files that can't be read."""

import io
import json
import os
import random

import pytest
from pyspark.sql import functions as F
from test_sources import agent, call, result, text, user, write

from loglathe.schema import PARSER_VERSION
from loglathe.sources import ranges, records
from loglathe.sources.blocks import normalise_blocks
from loglathe.streaming import tail


class Counted(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        out = super().read(n)
        self.taken += len(out)
        return out


def sessions(spark, plan):
    rows = [(os.path.basename(r.path).removesuffix(".jsonl"), str(r.stop), PARSER_VERSION) for r in plan.collect()]
    return spark.createDataFrame(rows, "session string, cursor string, parser_version int")


def said(events):
    return sorted((r.session, r.uid, r.kind, r.raw, r.outcome) for r in events.collect())


def test_chunks_hold_each_line_once(monkeypatch):
    r = random.Random(1)
    for _ in range(400):
        monkeypatch.setattr(ranges, "BLOCK", r.choice([1, 2, 3, 7, 50]))
        data = b"".join(bytes(r.choice(b"ab") for _ in range(r.randrange(6))) + b"\n" for _ in range(r.randrange(8))) + r.choice([b"", b"torn"])
        stop, size = ranges.last_line_end(io.BytesIO(data), 0, len(data)), r.randrange(1, 9)
        want, at = [], 0
        for line in data[:stop].split(b"\n")[:-1]:
            want.append((at, line))
            at += len(line) + 1
        assert [x for low in range(0, stop, size) for x in ranges.lines_between(io.BytesIO(data), low, min(low + size, stop), stop, low == 0)] == want


def test_bytes_read_are_those_that_are_new():
    old, new = b'{"a": 1}\n' * 500_000, b'{"b": 2}\n' * 10
    f = Counted(old + new)
    stop = ranges.last_line_end(f, len(old), len(old) + len(new))
    assert len(list(ranges.lines_between(f, len(old), stop, stop, True))) == 10
    assert stop == len(old) + len(new) and f.taken == 2 * len(new)
    head, end = Counted(old), Counted(old)
    assert len(list(ranges.head_lines(head, 40))) == 40 and head.taken <= 64 << 10
    assert len(list(ranges.tail_lines(end, len(old)))) == ranges.TAIL // 9 and end.taken == ranges.TAIL


def test_a_grown_a_shrunk_and_a_torn_file(spark, tmp_path):
    one, two, three = agent(text("one"), uuid="a1"), agent(text("two"), uuid="a2"), agent(text("three"), uuid="a3")
    cut = json.dumps(two)
    write(tmp_path, "p/grown.jsonl", one)
    write(tmp_path, "p/shrunk.jsonl", one, two, three)
    write(tmp_path, "p/torn.jsonl", one, tail=cut[:30])
    write(tmp_path, "p/same.jsonl", one)
    logs = records.BlockLogs(spark, str(tmp_path))
    first = logs.plan()
    assert {r[3] for r in said(logs.events(first))} == {"one", "two", "three"}
    write(tmp_path, "p/grown.jsonl", one, two)
    write(tmp_path, "p/shrunk.jsonl", three)
    write(tmp_path, "p/torn.jsonl", one, cut)
    again = logs.plan(sessions(spark, first))
    taken = {os.path.basename(r.path): (r.start, r.stop) for r in again.collect()}
    n = len(json.dumps(one)) + 1
    assert taken == {"grown.jsonl": (n, n + len(cut) + 1), "shrunk.jsonl": (0, len(json.dumps(three)) + 1), "torn.jsonl": (n, n + len(cut) + 1)}
    rows = ranges.read_ranges(again).select(F.regexp_extract("file", r"(\w+)\.jsonl", 1).alias("f"), "value").collect()
    assert sorted((r.f, json.loads(r.value)["uuid"]) for r in rows) == [("grown", "a2"), ("shrunk", "a3"), ("torn", "a2")]
    assert {r[3] for r in said(logs.events(again))} == {"two", "three"}


def test_many_chunks_of_one_file(spark, tmp_path, monkeypatch):
    write(tmp_path, "p/s.jsonl", *[agent(text("é%d" % i * (i % 7)), uuid="u%d" % i) for i in range(300)])
    whole = said(records.BlockLogs(spark, str(tmp_path)).events())
    monkeypatch.setattr(ranges, "CHUNK", 1000)
    logs = records.BlockLogs(spark, str(tmp_path))
    assert said(logs.events()) == whole and len(whole) > 200
    assert ranges.read_ranges(logs.plan()).select("pos.block").distinct().count() > 20
    assert [r.seq for r in logs.events().orderBy("seq").collect()] == list(range(len(whole)))


def test_one_corrupt_file_among_ten(spark, tmp_path):
    for i in range(10):
        write(tmp_path, f"p/s{i}.jsonl", agent(text("x"), sessionId=f"s{i}"))
    bad = tmp_path / "p/s3.jsonl"
    files = records.BlockLogs(spark, str(tmp_path))
    manifest = files.manifest().cache()
    assert manifest.count() == 10
    bad.unlink()

    class Stale(records.BlockLogs):
        def manifest(self):
            return manifest

    events, errors = records.read_all(spark, [Stale(spark, str(tmp_path))])
    assert sorted(r.session for r in events.collect()) == [f"s{i}" for i in range(10) if i != 3]
    assert [(r.source, r.path.endswith("s3.jsonl"), bool(r.error)) for r in errors.collect()] == [("blocks", True, True)]


def test_a_file_that_goes_after_the_plan(spark, tmp_path):
    gone = write(tmp_path, "p/s.jsonl", agent(text("x")))
    logs = records.BlockLogs(spark, str(tmp_path))
    plan = logs.plan()
    gone.unlink()
    with pytest.raises(Exception, match="was planned to be read"):
        logs.events(plan).collect()
    rows = ranges.read_ranges(plan, strict=False)
    assert [r.path.endswith("s.jsonl") for r in ranges.failures(plan, rows).collect()] == [True]


def test_events_come_of_one_scan_and_one_shuffle_of_texts(spark, tmp_path):
    write(tmp_path, "p/s.jsonl", agent(text("I look"), call("c", command="ls")), user([result("c", "a")]))
    for source in (records.BlockLogs, records.Rollouts):
        logs = source(spark, str(tmp_path))
        plan = logs.events(logs.plan())._jdf.queryExecution().executedPlan().toString()
        plan = plan[: plan.index("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan
        texts = plan[: plan.index("MapInArrow")]
        assert plan.count("MapInArrow") - plan.count("announced") <= 2 and texts.count("Exchange hashpartitioning") == 1


def test_facts_of_ends(spark, tmp_path):
    filler = [user([result("c", "y" * 4000)]) for _ in range(60)]
    write(tmp_path, "p/long.jsonl", {"type": "mode", "gitBranch": "HEAD"}, user("hi", cwd="/w/p", gitBranch="main"), *filler, agent(text("ho")), *filler[:3])
    write(tmp_path, "p/silent.jsonl", user("said long ago", cwd="/w"), *filler)
    got = {r.path[-12:]: (r.cwd, r.branch, r.assistant_last) for r in records.BlockLogs(spark, str(tmp_path)).facts().collect()}
    assert got == {"p/long.jsonl": ("/w/p", "main", True), "silent.jsonl": ("/w", None, None)}


def test_a_stream_of_growing_files(spark, tmp_path):
    root, out, marks = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "marks")
    one, two, three = (agent(text(t), uuid=t) for t in ("one", "two", "three"))
    cut = json.dumps(two)

    def step():
        stream = tail.grown(spark, str(root)).selectExpr("file", "pos.line AS at", "value")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
        rows = spark.read.schema("file string, at long, value string").parquet(out).collect()
        return sorted((os.path.basename(r.file), r.at, json.loads(r.value)["uuid"]) for r in rows)

    write(root, "p/s.jsonl", one, tail=cut[:30])
    write(root, "p/t.jsonl", three)
    assert step() == [("s.jsonl", 0, "one"), ("t.jsonl", 0, "three")]
    write(root, "p/s.jsonl", one, cut)
    n = len(json.dumps(one)) + 1
    assert step() == [("s.jsonl", 0, "one"), ("s.jsonl", n, "two"), ("t.jsonl", 0, "three")]
    write(root, "p/s.jsonl", one, cut, three, tail="{")
    write(root, "q/u.jsonl", two)
    got = step()
    assert got == [("s.jsonl", 0, "one"), ("s.jsonl", n, "two"), ("s.jsonl", n + len(cut) + 1, "three"), ("t.jsonl", 0, "three"), ("u.jsonl", 0, "two")]
    write(root, "p/t.jsonl", {"uuid": "x"})
    assert [x for x in step() if x not in got] == [("t.jsonl", 0, "x")]
    batch = normalise_blocks(ranges.read_ranges(records.BlockLogs(spark, str(root)).plan()))
    assert batch.count() == 4


def test_parts_since_a_mark(spark):
    from test_sources import tables

    t = tables(spark, ("p1", "m1", 1, 4, {"type": "text", "text": "a"}), ("p2", "m1", 2, 5, {"type": "text", "text": "b"}), ("p3", "m1", 3, 5, {"type": "text", "text": "c"}))
    mark = t.marks()
    assert sorted(r.uid for r in t.events(since=mark).collect()) == ["p2", "p3"]
    assert t.events(since=mark.limit(0)).count() == 3
