"""Markdown lines and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglathe.functions.identity import label
from loglathe.functions.text import clip, clock, flatten, note_lines

#: Code that opens and closes a fence, and a fence left open at the end.
_FENCED = r"(?ms)^[^\S\n]*(```|~~~)[^\n]*\n.*?(?:^[^\S\n]*\1[^\n]*$|\z)"
#: One place in a line: code, a link's target, or an address written out.
_PLACE = r"`[^`\n]+`|\[[^\]\n]*\]\(([^)\n]+)\)|(https?://[^\s)>]*)"


def links(text: Column) -> Column:
    """Distinct link targets in order: every ``[t](target)`` as it stands, and addresses written out,
    without the sentence's punctuation and longer than 8 bytes; none from code."""
    prose = F.regexp_replace(text, _FENCED, "")
    target = lambda n: F.regexp_extract_all(prose, F.lit(_PLACE), F.lit(n))
    bare = lambda u: F.regexp_replace(u, r"[.,;:!?]+$", "")
    found = F.zip_with(target(1), target(2), lambda t, u: F.when(t != "", t).when(F.octet_length(bare(u)) > 8, bare(u)).otherwise(""))
    return F.array_distinct(F.filter(found, lambda x: x != ""))


def web_links(text: Column) -> Column:
    """Those that may be opened: web addresses only."""
    return F.filter(links(text), lambda u: u.rlike("^https?://"))


#: The first pattern that fits a line tells its block; the groups are what is left as
#: its text.  A line that fits none is a paragraph, indentation and all.
BLOCKS = (
    ("blank", r"^\s*$"),
    ("heading", r"^\s*#+(.*)$"),
    ("rule", r"^\s*[-*_]{3,}\s*$"),
    ("bullet", r"^\s*(?:[-*+] |[0-9]+\. )(.*)$"),
    ("quote", r"^\s*> (.*)$"),
)


#: A fenced block, which an open fence ends with the text, or else a line: each match is a block.
_FENCE = r"[^\S\n]*+(```|~~~)[^\n]*+"
_MATCH = rf"(?md)^{_FENCE}(?:\z|\n(?s:.*?)(?:^[^\S\n]*+\1[^\n]*+$|\z))|^[^\n]*+$"


def blocks(text: Column) -> Column:
    """An array of (block_type, depth, text), one for each line and one for each fenced block, whose
    fences are left out; an open one ends with the text.  One search of the text finds all."""
    found = F.regexp_extract_all(F.regexp_replace(text, r"\n\z", ""), F.lit(_MATCH), F.lit(0))
    return F.transform(F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(found), _block)


def _code(block: Column) -> Column:
    """What stands between the fences."""
    lines = F.split(block, "\n")
    n, trimmed = F.size(lines), F.regexp_replace(F.element_at(lines, -1), r"^\s+", "")
    closed = (n > 1) & F.startswith(trimmed, F.regexp_extract(block, "^" + _FENCE, 1))
    return F.array_join(F.slice(lines, F.lit(2), F.greatest(F.when(closed, n - 2).otherwise(n - 1), F.lit(0))), "\n")


def _block(x: Column) -> Column:
    line = F.rtrim(x)
    kind = F.when(x.rlike("^" + _FENCE), "code")
    for name, pattern in BLOCKS:
        kind = kind.when(line.rlike(pattern), name)
    kind = kind.otherwise("para")
    inner = lambda name: F.regexp_extract(line, dict(BLOCKS)[name], 1)
    indent = F.octet_length(F.regexp_extract(line, r"^(\s*)", 1))
    depth = F.when(kind == "heading", F.length(F.regexp_extract(line, r"^\s*(#+)", 1))).when(kind == "bullet", F.floor(indent / 2)).otherwise(0)
    text = F.when(kind == "code", _code(x)).when(kind.isin("blank", "rule"), "").when(kind == "heading", F.trim(inner("heading"))).when(kind == "bullet", inner("bullet")).when(kind == "quote", inner("quote")).otherwise(line)
    return F.struct(kind.alias("block_type"), depth.cast("long").alias("depth"), text.alias("text"))


def exploded_blocks(events: DataFrame, key: str, text: str) -> DataFrame:
    """(key, block_no, block_type, depth, text) of each block."""
    out = events.select(key, F.posexplode(blocks(F.col(text))).alias("block_no", "b"))
    return out.select(key, F.col("block_no").cast("long").alias("block_no"), "b.*")


def speaker(kind: Column, tool: Column, agent: Column) -> Column:
    """Who a row is by: the agent for what it says, else the row's label."""
    return F.when(kind == "say", agent).otherwise(label(kind, tool))


def export_lines(feed: DataFrame) -> DataFrame:
    """(session, seq, line): a bullet with speaker and one-line text for each row, without a clock."""
    who = F.when(F.col("kind") == "prompt", "you").when(F.col("kind") == "say", "agent").otherwise(F.col("kind"))
    line = F.concat(F.lit("- **"), who, F.lit("** "), clip(flatten("raw"), 90))
    return feed.select("session", "seq", line.alias("line"))


def document_lines(feed: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session, seq, part, line) of a readable export.  A session (session, title, agent) opens with
    its title, and with its last time and number of rows; each row (session, seq, ts, kind, tool, gist,
    outcome) is a bullet with clock, speaker, headline and outcome, its notes indented below it."""
    spans = feed.groupBy("session").agg(F.max("ts").alias("last_ts"), F.count("*").alias("n"))
    about = F.concat(F.lit("_"), F.date_format("last_ts", "yyyy-MM-dd HH:mm"), F.lit(" · "), F.col("n").cast("string"), F.lit(" messages_"))
    head = F.posexplode(F.array(F.concat(F.lit("# "), "title"), F.lit(""), about, F.lit(""))).alias("part", "line")
    opening = sessions.join(spans, "session").select("session", F.lit(-1).cast("long").alias("seq"), head)
    rows = feed.join(sessions.select("session", "agent"), "session")
    split = F.split("gist", "\n")
    outcome = F.coalesce(F.concat(F.lit("  — "), "outcome"), F.lit(""))
    first = F.concat(F.lit("- `"), clock("ts"), F.lit("` **"), speaker(F.col("kind"), F.col("tool"), F.col("agent")), F.lit("** "), F.element_at(split, 1), outcome)
    notes = F.transform(F.slice(split, F.lit(2), F.size(split)), lambda x: F.concat(F.lit("    "), F.trim(x)))
    bullets = rows.select("session", F.col("seq").cast("long").alias("seq"), F.posexplode(F.concat(F.array(first), notes)).alias("part", "line"))
    return opening.unionByName(bullets)


def write_documents(lines: DataFrame, path: str) -> None:
    """One folder a session with its lines in order, as text."""
    lines.repartition("session").sortWithinPartitions("session", "seq", "part").select("session", "line").write.partitionBy("session").text(path)


def notes_of(events: DataFrame) -> DataFrame:
    """(session, seq, at, note, rank, text) of each line below a gist's headline."""
    return events.select("session", "seq", F.posexplode(note_lines("gist")).alias("at", "n")).select("session", "seq", "at", "n.*")
