"""Streams over files that arrive one after another."""

import json

import duckdb

from loglathe.plans import registry, streams
from loglathe.scratch import new_path
from loglathe.sources.blocks import normalise_blocks
from loglathe.streaming import jobs, tail


def test_tail_of_text_segments(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    out, marks = new_path(spark, "tail"), new_path(spark, "tail-marks")
    record = lambda i: json.dumps({"type": "user", "uuid": f"u{i}", "sessionId": "s", "timestamp": "2024-01-05T10:00:00Z", "message": {"content": f"prompt {i}"}})
    for i in range(3):
        torn = record(i + 1)[:30] if i == 1 else ""
        (folder / f"s-{i}.jsonl").write_text(record(i) + "\n" + torn)
        jobs.appended(normalise_blocks(tail.grown(spark, str(folder))).select("session", "uid", "raw"), out, marks)
    assert sorted((r.uid, r.raw) for r in spark.read.parquet(out).collect()) == [(f"u{i}", f"prompt {i}") for i in range(3)]


def test_folding_takes_a_stream_a_segment_and_one_at_the_end(spark, monkeypatch):
    """A stream costs its tasks' starts whatever it carries; all rows come, also without batches that carry none."""
    runs, real, idle = [], jobs.appended, "spark.sql.streaming.noDataMicroBatches.enabled"
    monkeypatch.setattr(jobs, "appended", lambda *args: runs.append(real(*args)))
    spark.conf.set(idle, "false")
    try:
        got = [tuple(r) for r in streams.stream_fold_results(spark, "/root/testdata/sf0.001").select("session", "call", "result").collect()]
    finally:
        spark.conf.unset(idle)
    con = duckdb.connect()
    con.sql("CREATE VIEW events AS SELECT * FROM '/root/testdata/sf0.001/events.parquet'")
    con.sql("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.001/conversations.parquet'")
    want = con.sql(registry.oracle_sql()["stream_fold_results"]).fetchall()
    assert want and sorted(got) == sorted(want)
    assert len(runs) == 4
