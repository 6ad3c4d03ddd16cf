"""Format 3: tables of parts and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglathe.functions.gists import line, with_gists
from loglathe.functions.tools import part_line, result_hint
from loglathe.sources.lines import shaped, string_of


def read_parts(parts: DataFrame, messages: DataFrame, since: Column) -> DataFrame:
    """Parts with their message, from ``since`` on, that time included: a part finished in the same
    millisecond as the last one read must not be skipped."""
    return parts.join(messages, "message").where(F.col("updated") >= since)


def part_table(parts: DataFrame, messages: DataFrame) -> DataFrame:
    """The stored tables joined: (session, uid, message, role, created, updated, data), times from
    milliseconds, the role from the message's JSON."""
    role = string_of(F.try_parse_json("data"), "role")
    m = messages.select(F.col("id").alias("message"), role.alias("role"))
    p = parts.select(F.col("session_id").alias("session"), F.col("id").alias("uid"), F.col("message_id").alias("message"), F.timestamp_millis("time_created").alias("created"), F.timestamp_millis("time_updated").alias("updated"), "data")
    return p.join(m, "message")


def parts_since(joined: DataFrame, marks: DataFrame) -> DataFrame:
    """Joined parts from each session's mark (session, updated) on, that time included; null marks and
    sessions without one take all."""
    at = marks.groupBy("session").agg(F.max("updated").alias("mark"))
    return joined.join(at, "session", "left").where(F.col("mark").isNull() | (F.col("updated") >= F.col("mark"))).drop("mark")


def high_water(joined: DataFrame) -> DataFrame:
    """(session, updated): where the next read of each session begins."""
    return joined.groupBy("session").agg(F.max("updated").alias("updated"))


def normalise_parts(joined: DataFrame) -> DataFrame:
    """Rows of ``lines.ROW`` of joined parts: text, reasoning, and tools that have finished.  Their
    order is (updated, created, uid); a call holds its result already."""
    v = F.col("v")
    rows = joined.withColumn("v", F.try_parse_json("data"))
    part, status = string_of(v, "type"), F.coalesce(string_of(v, "state.status"), F.lit(""))
    kind = (
        F.when((part == "text") & (F.coalesce(F.col("role"), F.lit("")) == "assistant"), "say")
        .when(part == "text", "prompt")
        .when(part == "reasoning", "think")
        .when((part == "tool") & ~status.isin("running", "pending"), "tool")
    )
    rows = rows.select(
        F.col("session").alias("file"),
        "session",
        F.struct("updated", "created", "uid").alias("pos"),
        "uid",
        F.col("created").alias("ts"),
        F.col("created").isNull().alias("ts_missing"),
        kind.alias("kind"),
        F.when(kind == "tool", F.coalesce(string_of(v, "tool"), F.lit("tool"))).alias("tool"),
        F.when(kind == "tool", F.try_variant_get(v, "$.state.input", "variant")).alias("given"),
        F.when(kind == "tool", F.coalesce(string_of(v, "state.output"), F.lit(""))).alias("output"),
        F.regexp_replace(F.coalesce(string_of(v, "text"), F.lit("")), r"^\s+|\s+$", "").alias("text"),
        ((kind == "tool") & (status == "error")).alias("is_error"),
    ).where("kind is not null and (kind = 'tool' or text <> '')")
    kind, output = F.col("kind"), F.col("output")
    body = F.coalesce(F.to_json("given"), F.lit("null"))
    fixed = F.when(kind == "tool", line(part_line(F.col("tool"), F.col("given"))))
    return shaped(
        with_gists(rows.withColumn("said", F.col("text")), fixed, by_marks=True),
        role=F.when(kind == "prompt", "user").when(kind == "tool", "tool").otherwise("assistant"),
        raw=F.when(kind != "tool", F.col("text")).when(output == "", body).otherwise(F.concat(body, F.lit("\n\n── result ──\n"), output)),
        hint=F.when(kind == "tool", result_hint(output, F.col("is_error"))),
    )


def part_sessions(parts: DataFrame, messages: DataFrame) -> DataFrame:
    """(session, parts, bytes) of sessions that have parts."""
    sizes = parts.groupBy("message").agg(F.count("*").alias("n"), F.sum(F.length("data")).alias("b"))
    return sizes.join(messages, "message").groupBy("session").agg(F.sum("n").alias("parts"), F.sum("b").alias("bytes"))
