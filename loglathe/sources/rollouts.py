"""Format 2: rollouts, one response item a line."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglathe.functions.gists import line, with_gists
from loglathe.functions.tools import result_hint, rollout_line
from loglathe.operators.sessions import carried
from loglathe.sources.lines import parsed, shaped, stem_of, string_of, texts_of

#: Openings of wrapper texts that only look like the user's.
INJECTED = ("<environment_context>", "<user_instructions>", "<skills_instructions>")


def injected(text: Column) -> Column:
    """Whether a text is the harness's description of the surroundings: it opens with a known tag, or
    with any tag and names a context."""
    text = F.ltrim(text)
    return reduce(lambda a, b: a | b, [text.startswith(x) for x in INJECTED]) | (text.startswith("<") & F.contains(text, F.lit("_context>")))


def announced(head: DataFrame) -> DataFrame:
    """(path, session) of the files that announce one in their first records: the last of these
    announcements counts for all rows, as a read that starts in the middle of a file has none."""
    v = F.col("v")
    rows = parsed(head).where(string_of(v, "type") == "session_meta")
    return rows.groupBy(F.col("file").alias("path")).agg(F.max_by(string_of(v, "payload.id"), "pos").alias("session"))


def carried_sessions(lines: DataFrame) -> DataFrame:
    """``lines`` with the session announced last before each line."""
    v = F.try_parse_json("value")
    return carried(lines, "file", F.when(string_of(v, "type") == "session_meta", string_of(v, "payload.id")), "session", ["pos"])


def normalise_rollout(lines: DataFrame) -> DataFrame:
    """Rows of ``lines.ROW``: messages, calls and their outputs, in one pass.  The session is that of the
    lines if they have one, else the file's.  An output fails if it speaks of an error."""
    v = F.col("v")
    session = F.coalesce("session", stem_of(F.col("file"))) if "session" in lines.columns else stem_of(F.col("file"))
    rows = parsed(lines).where(string_of(v, "type") == "response_item")
    item, role = string_of(v, "payload.type"), string_of(v, "payload.role")
    kind = (
        F.when((item == "message") & (role == "user"), "prompt")
        .when((item == "message") & (role == "assistant"), "say")
        .when(item.isin("function_call", "custom_tool_call"), "tool")
        .when(item.isin("function_call_output", "custom_tool_call_output"), "result")
    )
    call = string_of(v, "payload.call_id")
    rows = rows.select(
        "file",
        "pos",
        "ts",
        "ts_missing",
        session.alias("session"),
        kind.alias("kind"),
        F.coalesce(string_of(v, "payload.id"), call, F.lit("")).alias("uid"),
        F.coalesce(F.when(kind == "tool", F.coalesce(call, string_of(v, "payload.id"))).when(kind == "result", call), F.lit("")).alias("call_id"),
        F.when(kind == "tool", F.coalesce(string_of(v, "payload.name"), F.lit("tool"))).alias("tool"),
        F.when(kind == "tool", F.coalesce(string_of(v, "payload.input"), string_of(v, "payload.arguments"), F.lit(""))).when(kind == "result", texts_of(v, "payload.output")).otherwise(texts_of(v, "payload.content")).alias("raw"),
    ).where("kind is not null")
    kind, raw = F.col("kind"), F.col("raw")
    rows = rows.where((~kind.isin("prompt", "say") | raw.rlike(r"\S")) & ~((kind == "prompt") & injected(raw)))
    fixed = F.when(kind == "tool", line(rollout_line(F.col("tool"), raw))).when(kind == "result", line(raw, 90))
    return shaped(
        with_gists(rows.withColumn("said", raw), fixed, by_marks=True),
        role=F.when(kind == "prompt", "user").when(kind == "say", "assistant").otherwise("tool"),
        hint=F.when(kind == "result", result_hint(raw)),
        is_call=(kind == "tool"),
        is_error=(kind == "result") & F.contains(F.lower(raw), F.lit("error")),
    )
