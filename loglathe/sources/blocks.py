"""Format 1: user and assistant records whose content is a string or an array of blocks.

A record becomes an array of pieces, which is exploded once: no record is read twice and nothing is
shuffled.  Sidechains, bookkeeping records and injected user records give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglathe.functions.gists import UNLIMITED, line, with_gists
from loglathe.functions.text import between, slash_command
from loglathe.functions.tools import result_hint, tool_body, tool_line
from loglathe.schema import PROSE_LIMIT
from loglathe.sources.lines import flag_of, parsed, shaped, stem_of, string_of, texts_of


def _piece(kind: str | Column, text: Column, block: Column | None = None) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("piece"), text.alias("text"), (F.expr("CAST(NULL AS VARIANT)") if block is None else block).alias("b"))


def _pieces(v: Column) -> Column:
    """What a record says: queued prompt, compaction, notice, or the blocks of its content."""
    kind, content = string_of(v, "type"), string_of(v, "message.content")
    blocks = F.try_variant_get(v, "$.message.content", "array<variant>")
    prose = lambda b: F.coalesce(F.when(string_of(b, "type") == "thinking", string_of(b, "thinking")).otherwise(string_of(b, "text")), F.lit(""))
    each = F.transform(blocks, lambda b: _piece(string_of(b, "type"), prose(b), b))
    human = (string_of(v, "attachment.type") == "queued_command") & (string_of(v, "attachment.origin.kind") == "human")
    count = F.coalesce(F.try_variant_get(v, "$.messageCount", "bigint"), F.lit(0))
    compact = F.format_string("context compacted after %d messages", F.greatest(count, F.lit(0)))
    return (
        F.when(flag_of(v, "isSidechain"), None)
        .when((kind == "attachment") & human, F.array(_piece("text", F.coalesce(string_of(v, "attachment.prompt"), F.lit("")))))
        .when((kind == "system") & (string_of(v, "subtype") == "compact_boundary"), F.array(_piece("compact", compact)))
        .when((kind == "user") & flag_of(v, "isMeta"), None)
        .when((kind == "user") & (F.coalesce(string_of(v, "promptSource"), F.lit("")) == "system"), F.array(_piece("notice", F.coalesce(content, F.lit("")))))
        .when((kind == "user") & content.isNotNull(), F.array(_piece("text", content)))
        .when(kind.isin("user", "assistant"), each)
    )


def normalise_blocks(lines: DataFrame) -> DataFrame:
    """Rows of ``lines.ROW``.  The second and later prose block of a record gets ``uid#1``, ``uid#2``;
    blank ones don't count.  Output tokens stand on every text block of the message."""
    v = F.col("v")
    typed = F.when(string_of(v, "type") == "attachment", F.try_to_timestamp(string_of(v, "attachment.timestamp")))
    rows = parsed(lines).select(
        "file",
        "pos",
        "ts_missing",
        F.coalesce(typed, "ts").alias("ts"),
        F.coalesce(string_of(v, "sessionId"), stem_of(F.col("file"))).alias("session"),
        F.coalesce(string_of(v, "uuid"), F.lit("")).alias("record"),
        (string_of(v, "type") == "assistant").alias("by_agent"),
        F.greatest(F.coalesce(F.try_variant_get(v, "$.message.usage.output_tokens", "bigint"), F.lit(0)), F.lit(0)).alias("spent"),
        _pieces(v).alias("pieces"),
    )
    is_prose = lambda p: p.piece.isin("text", "thinking") & p.text.rlike(r"\S")
    rows = rows.withColumn("prose", F.transform("pieces", is_prose))
    rows = rows.select("*", F.posexplode("pieces").alias("sub", "p")).select("*", "p.*").drop("pieces", "p")
    piece, b, by_agent = F.col("piece"), F.col("b"), F.col("by_agent")
    text = F.regexp_replace(F.col("text"), r"^\s+|\s+$", "")
    nth = F.size(F.filter(F.slice("prose", F.lit(1), F.col("sub")), lambda x: x))
    kind = (
        F.when(piece.isin("compact", "notice"), "note")
        .when(~by_agent & (piece == "text") & (text != ""), "prompt")
        .when(by_agent & (piece == "text") & (text != ""), "say")
        .when(by_agent & (piece == "thinking") & (text != ""), "think")
        .when(by_agent & (piece == "tool_use"), "tool")
        .when(~by_agent & (piece == "tool_result"), "result")
    )
    summary = between(F.col("text"), "<summary>", "</summary>")
    rows = rows.withColumns({"kind": kind, "said": text}).where("kind is not null").where((piece != "notice") | (summary != ""))
    call = string_of(b, "id")
    rows = rows.withColumns(
        {
            "tool": F.when(F.col("kind") == "tool", F.coalesce(string_of(b, "name"), F.lit("tool"))),
            "given": F.when(F.col("kind") == "tool", F.try_variant_get(b, "$.input", "variant")),
            "call_id": F.coalesce(F.when(F.col("kind") == "tool", call).when(F.col("kind") == "result", string_of(b, "tool_use_id")), F.lit("")),
            "is_error": (F.col("kind") == "result") & flag_of(b, "is_error"),
            "body": F.when(F.col("kind") == "result", texts_of(b, "content")),
        }
    )
    kind = F.col("kind")
    fixed = (
        F.when(piece == "compact", line(F.col("text"), 1000))
        .when(kind == "note", line(summary, PROSE_LIMIT))
        .when(kind == "prompt", F.when(slash_command("said").isNotNull(), line(slash_command("said"), UNLIMITED)))
        .when(kind == "tool", line(tool_line(F.col("tool"), F.col("given"))))
        .when(kind == "result", line(F.col("body"), 90))
    )
    return shaped(
        with_gists(rows, fixed, by_marks=False),
        uid=F.when((kind == "tool") & call.isNotNull(), call).when(kind == "result", F.col("call_id")).when(kind.isin("prompt", "say", "think") & (nth > 0), F.concat_ws("#", "record", nth.cast("string"))).otherwise(F.col("record")),
        role=F.when(kind == "note", "system").when(kind == "prompt", "user").when(kind.isin("say", "think"), "assistant").otherwise("tool"),
        raw=F.when(piece == "compact", "context compacted").when(kind == "note", F.col("text")).when(kind == "tool", tool_body(F.col("tool"), F.col("given"))).when(kind == "result", F.col("body")).otherwise(F.col("said")),
        hint=F.when(kind == "result", result_hint(F.col("body"), F.col("is_error"))),
        is_call=(kind == "tool"),
        tokens=F.when(kind == "say", F.col("spent")).otherwise(0).cast("long"),
    )
