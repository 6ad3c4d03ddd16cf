"""Answers over all sessions at once: unread, states, spend, projects, search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loglathe.functions.text import ago, byte_size, seconds_between, tilde


def search(events: DataFrame, query: str, kinds: list[str], order: list[Column], limit: int = 200) -> DataFrame:
    """The first ``limit`` rows by ``order`` whose text, or summary if they have one, holds ``query``
    literally, in any case."""
    query = query.strip()
    if not query or not kinds:
        return events.limit(0)
    columns = [c for c in ("gist", "raw") if c in events.columns]
    hits = [F.coalesce(F.contains(F.lower(c), F.lit(query.lower())), F.lit(False)) for c in columns]
    return events.where(F.col("kind").isin(*kinds) & reduce(lambda a, b: a | b, hits)).orderBy(*order).limit(limit)


def grouped_hits(hits: DataFrame, order: list[Column]) -> DataFrame:
    """A search result with ``rank`` and ``caption`` where the session changes (few rows)."""
    w = Window.orderBy(*order)
    before = F.lag("session").over(w)
    return hits.withColumns({"rank": F.row_number().over(w), "caption": before.isNull() | (before != F.col("session"))})


def unread(events: DataFrame, seen: DataFrame, kinds: list[str]) -> DataFrame:
    """(session, unread, alerts) of each session ever opened: rows from its read mark on, and those
    of them that hold an alert line."""
    after = events.where(F.col("kind").isin(*kinds)).join(seen, "session").where(F.col("seq") >= F.col("seen"))
    counts = after.groupBy("session").agg(F.count("*").alias("unread"), F.count_if(F.contains("gist", F.lit("\n!"))).alias("alerts"))
    return seen.select("session").join(counts, "session", "left").na.fill(0, ["unread", "alerts"])


def mark_seen(log: DataFrame) -> DataFrame:
    """Read marks from the append-only log of (session, seen): the greatest."""
    return log.groupBy("session").agg(F.max("seen").alias("seen"))


def session_state(events: DataFrame, as_of: Column) -> DataFrame:
    """(session, first_ts, last_ts, last_speaker, state, awaiting): live below 120 s of quiet, waiting
    up to a day if the agent spoke last, else idle; awaiting if a prompt is the last word and the
    session was active within 300 s."""
    at = F.struct("ts", "uid")
    spoken = F.when(F.col("kind").isin("say", "prompt"), at)
    g = events.groupBy("session").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max_by("kind", spoken).alias("last_speaker"))
    quiet = seconds_between(as_of, F.col("last_ts"))
    state = F.when(quiet < 120, "live").when((F.col("last_speaker") == "say") & (quiet < 86400), "waiting").otherwise("idle")
    return g.withColumns({"state": state, "awaiting": F.coalesce((quiet <= 300) & (F.col("last_speaker") == "prompt"), F.lit(False))})


def spent(gists: DataFrame) -> DataFrame:
    return gists.agg(F.count("*").alias("calls"), F.coalesce(F.sum("tok_in"), F.lit(0)).alias("tok_in"), F.coalesce(F.sum("tok_out"), F.lit(0)).alias("tok_out"))


def session_tokens(events: DataFrame) -> DataFrame:
    """(session, tokens, rows): what a session's rows spent."""
    return events.groupBy("session").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))


def table_counts(**tables: DataFrame) -> DataFrame:
    """(name, rows) of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def most_common(df: DataFrame, column: str) -> DataFrame:
    """The most frequent value; of equals the least."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(1)


def display_names(sessions: DataFrame) -> DataFrame:
    """(id, name): the project if a session is alone in it, else its tag, with four characters of
    the id where siblings share the tag."""
    project = sessions.groupBy("project").agg(F.count("*").alias("np"))
    tags = sessions.groupBy("project", "tag").agg(F.count("*").alias("nt"))
    rows = sessions.join(project, "project").join(tags, ["project", "tag"])
    name = F.when(F.col("np") == 1, F.col("project").cast("string")).when(F.col("nt") == 1, F.col("tag")).otherwise(F.concat_ws("·", "tag", F.substring(F.col("id").cast("string"), 1, 4)))
    return rows.select("id", name.alias("name"))


def nearest_root(dirs: DataFrame, repos: DataFrame) -> DataFrame:
    """(path, root): the nearest ancestor directory of each path that is a repository's."""
    parts = F.split("path", "/")
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    ancestors = dirs.select("path").distinct().select("path", above.alias("root"))
    found = ancestors.join(repos.select("root"), "root").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    return dirs.select("path").distinct().join(found, "path", "left")


def hit_projects(hits: DataFrame, sessions: DataFrame) -> DataFrame:
    """A search result with ``title``: the project of a hit's session, else the id's first eight
    characters."""
    s = sessions.select(F.col("id").alias("session"), "project")
    short = F.substring(F.col("session").cast("string"), 1, 8)
    return hits.join(s, "session", "left").withColumn("title", F.coalesce(F.col("project").cast("string"), short)).drop("project")


def project_counts(sessions: DataFrame, live: Column) -> DataFrame:
    """(project, sessions, live, heading): a heading is shown where there is more than one."""
    g = sessions.groupBy("project").agg(F.count("*").alias("sessions"), F.count_if(live).alias("live"))
    return g.withColumn("heading", F.col("sessions") > 1)


def conversation_list(sessions: DataFrame, as_of: Column, here: Column, limit: int = 30) -> DataFrame:
    """(id, title, age, size, source) of the first ``limit`` sessions: those ``here`` first, then by
    recency."""
    top = sessions.orderBy(F.desc(F.coalesce(here, F.lit(False))), F.desc("modified"), "session").limit(limit)
    return top.select(F.substring(F.col("session").cast("string"), 1, 8).alias("id"), tilde("title", "home").alias("title"), ago(as_of, "modified").alias("age"), byte_size("bytes").alias("size"), "source")
