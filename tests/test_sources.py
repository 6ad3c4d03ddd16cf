"""The three formats, read from files and tables."""

import json

import pytest
from pyspark.sql import functions as F

from loglathe.functions.tools import part_gist, rollout_gist
from loglathe.operators import fold
from loglathe.schema import EVENTS
from loglathe.sources import blocks, lines, parts, records, rollouts

AT = "2024-01-05T10:00:00Z"


def write(folder, name, *rows, tail=""):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows) + tail)
    return path


def user(content, **more):
    return {"type": "user", "uuid": "u", "sessionId": "s", "timestamp": AT, "message": {"content": content}} | more


def agent(*blocks_, **more):
    return {"type": "assistant", "uuid": "a", "sessionId": "s", "timestamp": AT, "message": {"usage": {"output_tokens": 7}, "content": list(blocks_)}} | more


def call(i, name="Bash", **given):
    return {"type": "tool_use", "id": i, "name": name, "input": given}


def result(i, content, **more):
    return {"type": "tool_result", "tool_use_id": i, "content": content} | more


def text(t):
    return {"type": "text", "text": t}


def events(spark, tmp_path, *rows, tail=""):
    write(tmp_path, "p/s.jsonl", *rows, tail=tail)
    return records.BlockLogs(spark, str(tmp_path)).events().orderBy("seq").collect()


def test_result_folds_into_its_call(spark, tmp_path):
    got = events(spark, tmp_path, agent(text("I look"), call("c", command="ls -l")), user([result("c", "a\nb\nc")]))
    assert [(r.kind, r.tool, r.gist, r.outcome, r.is_error, r.seq) for r in got] == [("say", None, "I look", None, False, 0), ("tool", "Bash", "ls -l", "3 lines", False, 1)]
    assert got[1].raw == "ls -l\n\n── result ──\na\nb\nc" and [c for c in got[0].asDict()] == [x.split()[0] for x in EVENTS.split(", ")]


def test_two_calls_in_flight_and_repeated_ids(spark, tmp_path):
    got = events(spark, tmp_path, agent(call("c", command="one"), call("d", command="two")), user([result("d", "second"), result("c", [text("first")], is_error=True)]))
    assert [(r.uid, r.outcome, r.is_error) for r in got] == [("c", "first", True), ("d", "second", False)]


def test_orphan_failure_is_a_row_and_orphan_success_is_not(spark, tmp_path):
    got = events(spark, tmp_path, user([result("x", "it broke", is_error=True)]), user([result("y", "fine")]))
    assert [(r.kind, r.uid, r.raw, r.gist, r.is_error, r.role) for r in got] == [("fail", "x", "it broke", "it broke", True, "tool")]


def test_half_written_tail_waits(spark, tmp_path):
    whole = json.dumps(agent(text("later"), uuid="b"))
    assert [r.raw for r in events(spark, tmp_path, agent(text("now")), tail=whole[:40])] == ["now"]
    write(tmp_path, "p/s.jsonl", agent(text("now")), whole)
    assert [r.raw for r in records.BlockLogs(spark, str(tmp_path)).events().orderBy("seq").collect()] == ["now", "later"]


def test_queued_prompt_counts_from_when_it_was_typed(spark, tmp_path):
    queued = lambda kind: {"type": "attachment", "uuid": kind, "sessionId": "s", "timestamp": AT, "attachment": {"type": "queued_command", "prompt": " wait ", "timestamp": "2024-01-05T09:00:00Z", "origin": {"kind": kind}}}
    got = events(spark, tmp_path, queued("human"), queued("hook"))
    assert [(r.kind, r.raw, r.ts.hour) for r in got] == [("prompt", "wait", 9)]


def test_notices_compaction_and_cruft(spark, tmp_path):
    got = events(
        spark,
        tmp_path,
        user("<task><summary>  it is\n done </summary></task>", promptSource="system"),
        user("no summary", promptSource="system", uuid="v"),
        {"type": "system", "subtype": "compact_boundary", "uuid": "w", "sessionId": "s", "timestamp": AT, "messageCount": 40},
        user("reminder", isMeta=True),
        agent(text("inner"), isSidechain=True),
        *[{"type": t, "uuid": t} for t in ("summary", "mode", "last-prompt", "file-history-snapshot", "unknown")],
        agent(text("  "), {"type": "image"}),
        "[1, 2]",
        "",
        "not json",
    )
    assert [(r.kind, r.gist, r.role, r.raw[:17]) for r in got] == [("note", "it is done", "system", "<task><summary>  "), ("note", "context compacted after 40 messages", "system", "context compacted")]


def test_prompts_and_prose(spark, tmp_path):
    long = "word " * 60
    got = events(
        spark,
        tmp_path,
        user("<command-name>/go</command-name>\n<command-args> now </command-args>"),
        user(long, uuid="v"),
        user([text("two"), text(" "), text("parts")], uuid="w"),
        agent(text("first"), text(" "), {"type": "thinking", "thinking": "hm"}, text("**" + long + "**"), uuid="x"),
    )
    assert [(r.kind, r.uid, r.gist_src, r.tokens) for r in got] == [("prompt", "u", "rule", 0), ("prompt", "v", "pending", 0), ("prompt", "w", "verbatim", 0), ("prompt", "w#1", "verbatim", 0), ("say", "x", "verbatim", 7), ("think", "x#1", "verbatim", 0), ("say", "x#2", "pending", 7)]
    assert got[0].gist == "/go now" and got[0].raw.startswith("<command-name>")
    assert got[1].gist.endswith("…") and 190 < len(got[1].gist) <= 200 and len(got[6].gist) <= 90 and "*" not in got[6].gist


def test_missing_time_and_session(spark, tmp_path):
    write(tmp_path, "p/only.jsonl", {"type": "user", "message": {"content": "hi"}}, {"type": "user", "message": {"content": "ho"}})
    got = records.BlockLogs(spark, str(tmp_path)).events().orderBy("seq").collect()
    assert [(r.session, r.raw, r.ts is not None) for r in got] == [("only", "hi", True), ("only", "ho", True)]


def test_one_scan_and_no_shuffle(spark, tmp_path):
    write(tmp_path, "p/s.jsonl", agent(text("x")))
    plan = blocks.normalise_blocks(lines.read_lines(spark, str(tmp_path)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_manifest_and_facts(spark, tmp_path):
    write(tmp_path, "p/s.jsonl", {"type": "mode", "gitBranch": "HEAD"}, user("hi", cwd="/w/p", gitBranch="main"), agent(text("ho")), user([result("c", "x")]))
    write(tmp_path, "p/empty.jsonl")
    write(tmp_path, "p/notes.txt", "x")
    logs = records.BlockLogs(spark, str(tmp_path))
    assert [(r.session, r.bytes > 0) for r in logs.manifest().collect()] == [("s", True)]
    assert [(r.cwd, r.branch, r.assistant_last) for r in logs.facts().where("cwd is not null").collect()] == [("/w/p", "main", True)]


def item(**p):
    return {"type": "response_item", "timestamp": AT, "payload": p}


def test_rollouts(spark, tmp_path):
    write(
        tmp_path,
        "2024/01/05/rollout-2024-01-05-abcdefgh.jsonl",
        {"type": "session_meta", "payload": {"id": "real-id", "cwd": "/w", "git": {"branch": "dev"}}},
        {"type": "turn_context", "payload": {}},
        item(type="message", role="user", content=[{"type": "input_text", "text": "hi"}], id="m1"),
        item(type="message", role="user", content="<environment_context>x", id="m2"),
        item(type="message", role="user", content="<other_context>x", id="m3"),
        item(type="message", role="developer", content="x", id="m4"),
        item(type="message", role="assistant", content=[{"type": "output_text", "text": "ho"}], id="m5"),
        item(type="function_call", call_id="c", name="shell", arguments='{"cmd":"ls \\"a\\""}'),
        item(type="function_call_output", call_id="c", output="an Error"),
        item(type="custom_tool_call", call_id="d", name="patch", input="raw text"),
        item(type="function_call_output", call_id="lost", output="error"),
        item(type="reasoning", id="m6"),
    )
    logs = records.Rollouts(spark, str(tmp_path))
    got = logs.events().orderBy("seq").collect()
    assert [(r.session, r.kind, r.uid, r.gist, r.outcome, r.is_error) for r in got] == [
        ("real-id", "prompt", "m1", "hi", None, False),
        ("real-id", "say", "m5", "ho", None, False),
        ("real-id", "tool", "c", "ls \\", "an Error", True),
        ("real-id", "tool", "d", "patch raw text", None, False),
    ]
    assert logs.manifest().first().session == "abcdefgh"
    facts = logs.facts().first()
    assert (facts.cwd, facts.branch, facts.assistant_last) == ("/w", "dev", True)
    carried = rollouts.carried_sessions(lines.read_lines(spark, str(tmp_path))).select("session").distinct().collect()
    assert [r.session for r in carried] == ["real-id"]


@pytest.mark.parametrize(
    ("name", "body", "gist"),
    [
        ("exec", 'await run({"cmd":"cat a\\\\nb"})', "cat a\\ b"),
        ("exec", 'run({"cmd":"ls\\nb"})', "ls b"),
        ("other", '{"a": "short", "b": "longer one", "n": 5}', "longer one"),
        ("other", '{"n": 5}', 'other {"n": 5}'),
        ("other", "free  text", "other free text"),
    ],
)
def test_rollout_gists(spark, name, body, gist):
    assert spark.range(1).select(rollout_gist(F.lit(name), F.lit(body))).first()[0] == gist


@pytest.mark.parametrize(
    ("name", "given", "gist"),
    [
        ("bash", {"command": "ls\n-l"}, "ls -l"),
        ("read", {"filePath": "/a/b.py"}, "b.py"),
        ("edit", {"filePath": "/a/c.py", "oldString": "x" * 50}, "c.py"),
        ("grep", {"pattern": "x+"}, "x+"),
        ("webfetch", {"url": "http://x"}, "http://x"),
        ("task", {"a": "bb", "c": "ddd"}, "ddd"),
        ("task", {"a": 5}, "task"),
        ("bash", {}, "bash"),
    ],
)
def test_part_gists(spark, name, given, gist):
    assert spark.range(1).select(part_gist(F.lit(name), F.parse_json(F.lit(json.dumps(given))))).first()[0] == gist


def tables(spark, *rows):
    sessions = spark.createDataFrame([("s", "/w", "t", 2000), ("t", "/v", "u", 1000)], "id string, directory string, title string, time_updated long")
    messages = spark.createDataFrame([("m1", "s", 1, '{"role": "user"}'), ("m2", "s", 2, '{"role": "assistant"}')], "id string, session_id string, time_created long, data string")
    parts_ = spark.createDataFrame([(i, m, "s", c, u, json.dumps(d)) for i, m, c, u, d in rows], "id string, message_id string, session_id string, time_created long, time_updated long, data string")
    return records.PartTables(sessions, messages, parts_)


def tool(status, **state):
    return {"type": "tool", "tool": "bash", "state": {"status": status, "input": {"command": "ls"}} | state}


def test_parts(spark):
    t = tables(
        spark,
        ("p1", "m1", 1, 1, {"type": "text", "text": " hi "}),
        ("p2", "m2", 2, 2, {"type": "reasoning", "text": "hm"}),
        ("p3", "m2", 3, 9, tool("completed", output="one\ntwo")),
        ("p4", "m2", 4, 4, tool("running")),
        ("p5", "m2", 5, 5, tool("error", output="it broke")),
        ("p6", "m2", 6, 6, {"type": "step-start"}),
        ("p7", "m2", 7, 9, {"type": "text", "text": "done"}),
        ("p8", "m2", 8, 8, tool("error")),
    )
    got = t.events().orderBy("seq").collect()
    assert [(r.uid, r.kind, r.gist, r.outcome, r.is_error, r.role) for r in got] == [
        ("p1", "prompt", "hi", None, False, "user"),
        ("p2", "think", "hm", None, False, "assistant"),
        ("p5", "tool", "ls", "it broke", True, "tool"),
        ("p8", "tool", "ls", "failed", True, "tool"),
        ("p3", "tool", "ls", "2 lines", False, "tool"),
        ("p7", "say", "done", None, False, "assistant"),
    ]
    assert got[4].raw == '{"command":"ls"}\n\n── result ──\none\ntwo' and got[3].raw == '{"command":"ls"}'
    assert [(r.session, r.updated.microsecond) for r in t.marks().collect()] == [("s", 9000)]
    assert [(r.session, r.bytes > 0) for r in t.manifest().collect()] == [("s", True)]
    assert {(r.path, r.cwd, r.assistant_last) for r in t.facts().collect()} == {("s", "/w", True), ("t", "/v", None)}


def test_a_part_of_the_same_millisecond_is_read_again(spark):
    t = tables(spark, ("p1", "m1", 1, 5, {"type": "text", "text": "a"}), ("p2", "m1", 2, 5, {"type": "text", "text": "b"}))
    joined = parts.part_table(t.parts, t.messages)
    mark = parts.high_water(joined).first().updated
    assert joined.where(F.col("updated") >= F.lit(mark)).count() == 2


def test_an_unreadable_source_adds_an_error(spark, tmp_path):
    write(tmp_path, "good/s.jsonl", agent(text("x")))
    all_events, errors = records.read_all(spark, [records.BlockLogs(spark, str(tmp_path / "good")), records.Rollouts(spark, str(tmp_path / "missing"))])
    assert all_events.count() == 1 and [r.source for r in errors.collect()] == ["rollouts"]


def test_folding_equals_a_sequential_map(spark):
    import random

    r = random.Random(3)
    rows = [("f%d" % r.randrange(5), i, 0, r.choice(["", "a", "b", "c"]), r.random() < 0.5, "b%d" % i, r.random() < 0.5) for i in range(300)]
    d = spark.createDataFrame(rows, "file string, pos int, sub int, call_id string, is_call boolean, body string, is_error boolean")
    open_, want, lost = {}, {}, set()
    for f, i, _, c, is_call, body, err in rows:
        if is_call:
            want[i] = None
            if c:
                open_[f, c] = i
        elif c and (f, c) in open_:
            want[open_.pop((f, c))] = body
        elif err:
            lost.add(i)
    assert {x.pos: x.outcome for x in fold.fold_results(d, ["pos", "sub"]).collect()} == want
    assert {x.pos for x in fold.orphan_failures(d, ["pos", "sub"]).collect()} == lost
