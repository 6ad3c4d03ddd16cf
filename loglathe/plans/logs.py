"""Queries of the three log formats: conversations are written out in each and read back."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglathe.operators.archive import resume
from loglathe.operators.fold import events_of, folded
from loglathe.plans.registry import _clip, _flat, query
from loglathe.schema import PARSER_VERSION
from loglathe.scratch import new_path
from loglathe.sources import lines, ranges, records
from loglathe.sources.blocks import normalise_blocks
from loglathe.sources.rollouts import normalise_rollout
from loglathe.sources.views import as_of, conversation_events

_STAMP = "2024-01-05T10:00:00Z"


def _obj(**fields: Column | str) -> Column:
    return F.struct(*[(F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items()])


def _json_lines(rows: DataFrame, value: Column) -> DataFrame:
    return rows.select(F.col("session").cast("string").alias("file"), F.col("seq").alias("pos"), value.alias("value"), as_of().alias("file_ts"))


def block_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as prompts that first hand back the result of the call before; assistant turns as
    prose and a call; system turns as notices.  Each session's lines stand in its own file."""
    e = conversation_events(spark, sf_dir)
    uid, raw = F.col("uid"), F.col("raw")
    before = F.concat_ws("-", "session", F.col("seq") - 1)
    say = F.to_json(F.array(_obj(type="text", text=raw)))
    call = F.to_json(F.array(_obj(type="tool_use", id=F.concat(F.lit("c"), uid), name="Bash", input=_obj(command=F.concat(F.lit("run "), F.left(raw, F.lit(150)))))))
    result = F.to_json(F.array(_obj(type="tool_result", tool_use_id=F.concat(F.lit("c"), before), is_error=F.col("seq") % 3 == 0, content=F.left(raw, F.lit(80)))))
    joined = lambda a, b: F.parse_json(F.concat(F.regexp_replace(a, r"\]$", ","), F.regexp_replace(b, r"^\[", "")))
    notice = F.variant_get(F.parse_json(F.to_json(_obj(x=F.concat(F.lit("<summary>"), raw, F.lit("</summary>"))))), "$.x", "variant")
    content = F.when(F.col("role") == "user", joined(result, say)).when(F.col("role") == "assistant", joined(say, call)).otherwise(notice)
    usage = _obj(output_tokens=F.length("raw"))
    kind = F.when(F.col("role") == "system", "user").otherwise(F.col("role"))
    source = F.when(F.col("role") == "system", "system").otherwise("user")
    value = F.to_json(_obj(type=kind, uuid=uid, sessionId=F.col("session").cast("string"), timestamp=_STAMP, promptSource=source, message=_obj(content=content, usage=usage)))
    return _json_lines(e, value)


_PLAIN = r"translate(regexp_replace(raw, '\]\([^)]*(\)|$)', '', 'g'), '`*_#>[]', '')"
_TRIM = r"regexp_replace(raw, '^\s+|\s+$', '', 'g')"


def _shown(first_format: bool) -> str:
    """Gist of a prose row (kind, raw) in SQL."""
    one = _flat("raw") if first_format else _flat(_PLAIN)
    prompt = f"CASE WHEN length({one}) <= 200 THEN {one} ELSE {_clip(one, 200 if first_format else 90)} END"
    prose = f"CASE WHEN length({one}) <= 96 THEN {one} ELSE {_clip(_flat(_PLAIN), 90)} END"
    return f"CASE WHEN kind = 'prompt' THEN {prompt} ELSE {prose} END"


def _waits(first_format: bool) -> str:
    one = _flat("raw") if first_format else _flat(_PLAIN)
    return f"CASE WHEN length({one}) <= CASE WHEN kind = 'prompt' THEN 200 ELSE 96 END THEN 'verbatim' ELSE 'pending' END"


def _hint(x: str, failed: str = "false") -> str:
    t = rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
    n = f"len(string_split({t}, chr(10)))"
    return f"CASE WHEN {t} = '' AND {failed} THEN 'failed' WHEN {t} = '' THEN 'ok' WHEN {failed} THEN {_clip(_flat(t), 60)} WHEN {n} <= 1 AND length({t}) <= 48 THEN {_flat(t)} ELSE {n} || CASE WHEN {n} = 1 THEN ' line' ELSE ' lines' END END"


def _answered(raw: str, body: str) -> str:
    return f"CASE WHEN coalesce({body}, '') = '' THEN {raw} ELSE {raw} || chr(10) || chr(10) || '── result ──' || chr(10) || {body} END"


_KEPT = "session, uid, kind, tool, gist, gist_src, outcome, is_error, tokens, seq, md5(raw) AS raw_md5"
_RESULT = "left(n.raw, 80)"
_BLOCK_SQL = f""", told AS (SELECT *, {_TRIM} AS said FROM ev_conv),
prose AS (SELECT CAST(session AS VARCHAR) AS session, seq, 1 AS sub, uid, kind, NULL AS tool, said AS raw, {_shown(True).replace("raw", "said")} AS gist, {_waits(True).replace("raw", "said")} AS gist_src,
  NULL AS outcome, false AS is_error, CASE WHEN kind = 'say' THEN length(raw) ELSE 0 END AS tokens FROM told WHERE kind IN ('prompt', 'say') AND said <> ''),
notes AS (SELECT CAST(session AS VARCHAR) AS session, seq, 0 AS sub, uid, kind, NULL AS tool, '<summary>' || raw || '</summary>' AS raw, {_clip(_flat("raw"), 96)} AS gist, 'rule' AS gist_src, NULL AS outcome, false AS is_error, 0 AS tokens FROM ev_conv WHERE kind = 'note' AND raw <> ''),
calls AS (SELECT CAST(e.session AS VARCHAR) AS session, e.seq, 2 AS sub, 'c' || e.uid AS uid, 'tool' AS kind, 'Bash' AS tool, {_answered("('run ' || left(e.raw, 150))", _RESULT)} AS raw, {_clip(_flat("('run ' || left(e.raw, 150))"), 110)} AS gist, 'rule' AS gist_src,
  CASE WHEN n.raw IS NOT NULL THEN {_hint(_RESULT, "(n.seq % 3 = 0)")} END AS outcome, coalesce(n.seq % 3 = 0, false) AS is_error, 0 AS tokens FROM ev_conv e LEFT JOIN ev_conv n ON n.session = e.session AND n.seq = e.seq + 1 AND n.role = 'user' WHERE e.kind = 'say'),
lost AS (SELECT CAST(e.session AS VARCHAR) AS session, e.seq, 0 AS sub, 'c' || e.session || '-' || (e.seq - 1) AS uid, 'fail' AS kind, NULL AS tool, left(e.raw, 80) AS raw, {_clip(_flat("left(e.raw, 80)"), 90)} AS gist, 'rule' AS gist_src, NULL AS outcome, true AS is_error, 0 AS tokens
  FROM ev_conv e LEFT JOIN ev_conv p ON p.session = e.session AND p.seq = e.seq - 1 AND p.kind = 'say' WHERE e.kind = 'prompt' AND p.uid IS NULL AND e.seq % 3 = 0),
every AS (SELECT * FROM prose UNION ALL SELECT * FROM notes UNION ALL SELECT * FROM calls UNION ALL SELECT * FROM lost),
numbered AS (SELECT * EXCLUDE (seq), row_number() OVER (PARTITION BY session ORDER BY seq, sub) - 1 AS seq FROM every)
SELECT {_KEPT} FROM numbered"""


def _kept(events: DataFrame) -> DataFrame:
    return events.select("session", "uid", "kind", "tool", "gist", "gist_src", "outcome", "is_error", "tokens", "seq", F.md5(F.col("raw").cast("binary")).alias("raw_md5"))


@query(_BLOCK_SQL)
def block_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(events_of(normalise_blocks(block_lines(spark, sf_dir)), "blocks"))


def _put(table: pa.Table) -> pa.Table:
    """One session's lines as a file of its own, the last one torn."""
    path = table.column("folder")[0].as_py() + f"/{table.column('file')[0].as_py()}.jsonl"
    rows = table.sort_by("pos").column("value").to_pylist()
    store, inner = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    with store.open_output_stream(inner) as f:
        f.write("".join(r + "\n" for r in rows).encode() + b'{"type": "user", "mess')
    return pa.table({"path": [path]})


def written(rows: DataFrame) -> str:
    """The lines (file, pos, value) as a folder of files, which a transcript's program would write."""
    spark = rows.sparkSession
    root = new_path(spark, "transcripts")
    spark.createDataFrame([("",)], "x string").coalesce(1).write.text(root)  # makes the folder, in any store
    local = "/" + root[5:].lstrip("/") if root.startswith("file:") else root
    rows.select("file", "pos", "value", F.lit(local).alias("folder")).groupBy("file").applyInArrow(_put, "path string").write.format("noop").mode("overwrite").save()
    return root


def _named(rows: DataFrame) -> DataFrame:
    return rows.withColumn("file", lines.stem_of(F.col("file")))


@query("SELECT CAST(session AS VARCHAR) AS file, arg_max(kind = 'say', seq) FILTER (kind IN ('say', 'prompt')) AS assistant_last FROM ev_conv WHERE trim(raw) <> '' GROUP BY session")
def last_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the last bytes of each file."""
    files = lines.manifest(spark, written(block_lines(spark, sf_dir)))
    return _named(lines.last_speaker(normalise_blocks(ranges.tails(files))))


@query("SELECT CAST(session AS VARCHAR) AS file, '/w/' || session || '/' || min(seq) AS cwd, arg_min('b' || seq, seq) FILTER (seq % 3 <> 0) AS branch FROM ev_conv GROUP BY session")
def first_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first records of each file."""
    branch = F.when(F.col("seq") % 3 == 0, "HEAD").otherwise(F.concat(F.lit("b"), F.col("seq").cast("string")))
    value = F.to_json(_obj(cwd=F.concat_ws("/", F.lit("/w"), "session", "seq"), gitBranch=branch))
    files = lines.manifest(spark, written(_json_lines(conversation_events(spark, sf_dir), value)))
    return _named(lines.first_facts(ranges.heads(files)))


@query(_BLOCK_SQL)
def resumed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files read twice: as they were when they were half as long (where that falls into a line, the line
    waits), and from that read's cursor on.  Both reads' rows together give the events of a whole read."""
    files = lines.manifest(spark, written(block_lines(spark, sf_dir)))
    zero = F.lit(0).cast("long").alias("start")
    first = ranges.planned(files.select("path", "mtime", F.floor(F.col("bytes") / 2).alias("bytes"), zero))
    kept = first.select(lines.stem_of(F.col("path")).alias("session"), F.col("stop").cast("string").alias("cursor"), F.lit(PARSER_VERSION).alias("parser_version"))
    again = ranges.planned(resume(files, kept, PARSER_VERSION))
    rows = ranges.read_ranges(first).unionByName(ranges.read_ranges(again))
    return _kept(events_of(normalise_blocks(rows), "blocks"))


def rollout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as messages; an assistant's is followed by a call and its output."""
    e = conversation_events(spark, sf_dir)
    raw, uid = F.col("raw"), F.col("uid")
    item = lambda **p: F.to_json(_obj(type="response_item", timestamp=_STAMP, payload=_obj(**p)))
    message = item(type="message", role=F.when(F.col("role") == "system", "developer").otherwise(F.col("role")), id=uid, content=F.array(_obj(type="text", text=raw)))
    arguments = F.to_json(_obj(a=F.left(raw, F.lit(20)), b=F.left(raw, F.lit(150))))
    given = F.when(F.col("seq") % 2 == 0, arguments).otherwise(F.concat(F.lit('run({"cmd":"ls '), F.col("session").cast("string"), F.lit('\\n-l"})')))
    call = item(type="function_call", call_id=uid, name="shell", arguments=given)
    output = item(type="function_call_output", call_id=uid, output=F.when(F.col("seq") % 3 == 0, F.concat(F.lit("an Error\nat "), uid)).otherwise(""))
    each = F.when(F.col("role") == "assistant", F.array(message, call, output)).otherwise(F.array(message))
    split = e.select("session", F.col("seq").alias("at"), F.posexplode(each).alias("i", "value"))
    return _json_lines(split.withColumn("seq", F.col("at") * 10 + F.col("i")), F.col("value"))


_OUTPUT = "CASE WHEN seq % 3 = 0 THEN 'an Error' || chr(10) || 'at ' || uid ELSE '' END"
_GIVEN = """CASE WHEN seq % 2 = 0 THEN CAST(to_json({'a': left(raw, 20), 'b': left(raw, 150)}) AS VARCHAR) ELSE 'run({"cmd":"ls ' || session || '\\n-l"})' END"""
_SHELL = f"CASE WHEN seq % 2 = 0 THEN {_clip(_flat('left(raw, 150)'), 110)} ELSE 'ls ' || session || ' -l' END"
_ROLLOUT_SQL = f""", told AS (SELECT CAST(session AS VARCHAR) AS session, seq * 10 AS seq, uid, kind, NULL AS tool, raw, {_shown(False)} AS gist, {_waits(False)} AS gist_src, NULL AS outcome, false AS is_error FROM ev_conv WHERE kind IN ('prompt', 'say') AND trim(raw) <> ''),
calls AS (SELECT CAST(session AS VARCHAR) AS session, seq * 10 + 1 AS seq, uid, 'tool' AS kind, 'shell' AS tool, {_answered(_GIVEN, f"({_OUTPUT})")} AS raw, {_SHELL} AS gist, 'rule' AS gist_src, CASE WHEN seq % 3 = 0 THEN '2 lines' ELSE 'ok' END AS outcome, seq % 3 = 0 AS is_error FROM ev_conv WHERE kind = 'say')
SELECT session, uid, kind, tool, gist, gist_src, outcome, is_error FROM (SELECT * FROM told UNION ALL SELECT * FROM calls)"""


@query(_ROLLOUT_SQL)
def rollout_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folded(normalise_rollout(rollout_lines(spark, sf_dir)), orphans=False).select("session", "uid", "kind", "tool", "gist", "gist_src", "outcome", "is_error")


def part_tables(spark: SparkSession, sf_dir: str) -> records.PartTables:
    """Each turn a message with a text part; an assistant's has a tool part too, some still running."""
    e = conversation_events(spark, sf_dir)
    s = F.col("session").cast("string")
    at = (F.col("seq") * 1000).cast("long")
    kept = e.select(s.alias("session_id"), F.col("uid").alias("message_id"), at.alias("time_created"), (at + 5).alias("time_updated"), "role", "raw", "seq")
    role = F.when(F.col("role") == "system", "user").otherwise(F.col("role"))
    messages = kept.select(F.col("message_id").alias("id"), "session_id", "time_created", F.to_json(_obj(role=role)).alias("data"))
    text = F.to_json(_obj(type=F.when(F.col("seq") % 5 == 4, "reasoning").otherwise("text"), text=F.col("raw")))
    status = F.when(F.col("seq") % 4 == 1, "running").when(F.col("seq") % 4 == 2, "error").otherwise("completed")
    output = F.when(F.col("seq") % 4 == 3, F.left("raw", F.lit(60))).otherwise("")
    tool = F.to_json(_obj(type="tool", tool="grep", state=_obj(status=status, input=_obj(pattern=F.left("raw", F.lit(30))), output=output)))
    each = F.when(F.col("role") == "assistant", F.array(text, tool)).otherwise(F.array(text))
    p = kept.select("session_id", "message_id", "time_created", "time_updated", F.posexplode(each).alias("i", "data"))
    p = p.select(F.concat_ws(".", "message_id", "i").alias("id"), "message_id", "session_id", "time_created", "time_updated", "data")
    sessions = e.groupBy(s.alias("id")).agg(F.max(at).alias("time_updated")).select("id", F.concat(F.lit("/w/"), "id").alias("directory"), F.lit("t").alias("title"), "time_updated")
    return records.PartTables(sessions, messages, p)


_PART_SQL = f""", told AS (SELECT session, seq, uid || '.0' AS uid, CASE WHEN seq % 5 = 4 THEN 'think' WHEN role = 'assistant' THEN 'say' ELSE 'prompt' END AS kind, NULL AS tool, {_TRIM} AS raw, NULL AS outcome, false AS is_error FROM ev_conv WHERE {_TRIM} <> ''),
shown AS (SELECT *, {_shown(False)} AS gist, {_waits(False)} AS gist_src FROM told),
calls AS (SELECT session, seq, uid || '.1' AS uid, 'tool' AS kind, 'grep' AS tool, raw, CASE WHEN seq % 4 = 2 THEN 'failed' WHEN seq % 4 = 3 THEN {_hint("left(raw, 60)")} ELSE 'ok' END AS outcome, seq % 4 = 2 AS is_error,
  CASE WHEN trim(left(raw, 30)) = '' THEN 'grep' ELSE {_clip(_flat("left(raw, 30)"), 110)} END AS gist, 'rule' AS gist_src FROM ev_conv WHERE role = 'assistant' AND seq % 4 <> 1)
SELECT CAST(session AS VARCHAR) AS session, uid, kind, tool, gist, gist_src, outcome, is_error FROM (SELECT session, uid, kind, tool, gist, gist_src, outcome, is_error FROM shown UNION ALL SELECT session, uid, kind, tool, gist, gist_src, outcome, is_error FROM calls)"""


@query(_PART_SQL)
def part_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_tables(spark, sf_dir).events().select("session", "uid", "kind", "tool", "gist", "gist_src", "outcome", "is_error")


@query("SELECT CAST(session AS VARCHAR) AS session, make_timestamp((max(seq) * 1000 + 5) * 1000) AS updated FROM ev_conv GROUP BY session")
def part_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_tables(spark, sf_dir).marks().select("session", F.col("updated").cast("timestamp_ntz").alias("updated"))
