"""Turns and the feed made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loglathe.functions.gists import prose_gist
from loglathe.functions.identity import content_hash
from loglathe.operators.pieces import running_sum

#: Kinds that end a run of prose.
BREAKS = ("say", "prompt", "note")


def runs(events: DataFrame, order: list[str]) -> DataFrame:
    """Prose rows with ``run``: consecutive ``say`` rows of a session share one, a prompt or note
    ends it, tools and thoughts don't.  Runs are found over the whole stream, before anything is
    hidden, so what is shown doesn't change them."""
    return running_sum(events.where(F.col("kind").isin(*BREAKS)), ["session"], order, (F.col("kind") != "say").cast("int"), "run")


def fuse_turns(events: DataFrame, order: list[str]) -> DataFrame:
    """(session, run, n, last_ts, tokens, raw, uid) of the runs of two rows or more: texts joined by
    a blank line in order, tokens summed, at the last row's time."""
    say = runs(events, order).where(F.col("kind") == "say")
    key = F.struct(*order, F.col("raw").alias("raw_"), F.col("uid").alias("uid_"))
    g = say.groupBy("session", "run").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"), F.sum("tokens").alias("tokens"), F.sort_array(F.collect_list(key)).alias("rows"))
    text = F.array_join(F.transform("rows", lambda r: r.raw_), "\n\n")
    uid = F.concat_ws("+", F.element_at("rows", 1)["uid_"].cast("string"), F.col("n").cast("string"))
    return g.where(F.col("n") > 1).select("session", "run", "n", "last_ts", "tokens", text.alias("raw"), uid.alias("uid"))


def feed_rows(events: DataFrame, order: list[str]) -> DataFrame:
    """One row for each fused turn, at its last block, and every other row: (session, uid, kind, ts,
    n, tokens)."""
    say = runs(events, order).where(F.col("kind") == "say")
    g = Window.partitionBy("session", "run")
    last = F.row_number().over(g.orderBy(*[F.desc(c) for c in order])) == 1
    fused = say.withColumns({"n": F.count("*").over(g), "tokens": F.sum("tokens").over(g), "last": last}).where("last")
    cols = ["session", "uid", "kind", "ts", "n", "tokens"]
    return fused.select(*cols).unionByName(events.where(F.col("kind") != "say").withColumn("n", F.lit(1).cast("long")).select(*cols))


def fused_gists(turns: DataFrame) -> DataFrame:
    """Fused turns with the gist, its source and the hash of their joined text: a fused message is
    condensed as one."""
    gist, src = prose_gist(F.col("raw"))
    return turns.withColumns({"gist": gist, "gist_src": src, "hash": content_hash(F.lit("say"), F.lit(None).cast("string"), F.col("raw"))})


def messages(events: DataFrame, order: list[str]) -> DataFrame:
    """The feed with its texts: fused turns and every row that isn't part of one, (session, uid, kind,
    ts, n, tokens, raw, at); ``at`` is the uid of the row where a message stands."""
    say = runs(events, order).where(F.col("kind") == "say")
    last = F.max_by("uid", F.struct(*order)).alias("at")
    where = say.groupBy("session", "run").agg(last)
    fused = fuse_turns(events, order).join(where, ["session", "run"]).withColumnRenamed("last_ts", "ts").withColumn("kind", F.lit("say"))
    single = say.withColumn("n", F.count("*").over(Window.partitionBy("session", "run"))).where("n = 1")
    cols = ["session", F.col("uid").cast("string").alias("uid"), "kind", "ts", "n", "tokens", "raw", F.col("at").cast("string").alias("at")]
    others = events.where(F.col("kind") != "say").withColumn("n", F.lit(1).cast("long"))
    out = fused.select(*cols)
    for df in (single, others):
        out = out.unionByName(df.withColumn("at", F.col("uid")).select(*cols))
    return out


def origins(events: DataFrame, order: list[str]) -> DataFrame:
    """The merged feed of all sessions with ``caption``: true where the session changes.  Hours are
    judged apart and joined at their edges, so no task sorts the whole log or a day of it."""
    day = F.date_trunc("hour", "ts")
    w = Window.partitionBy("day").orderBy(*order)
    rows = events.withColumn("day", day).withColumn("before", F.lag("session").over(w))
    edge = rows.groupBy("day").agg(F.max_by("session", F.struct(*order)).alias("last"))
    edge = edge.withColumn("prior", F.lag("last").over(Window.orderBy("day")))
    rows = rows.join(edge.select("day", "prior"), "day", "left")
    before = F.coalesce("before", "prior")
    return rows.withColumn("caption", before.isNull() | (before != F.col("session"))).drop("day", "before", "prior")


def visible(events: DataFrame, thinking: bool = False, tools: bool = False, archive: bool = False) -> DataFrame:
    """Rows shown: failures always in the feed, but in the archive only with tools."""
    hidden = [k for k, on in (("think", thinking), ("tool", tools), ("fail", tools or not archive)) if not on]
    return events.where(~F.col("kind").isin(*hidden)) if hidden else events


def text_filter(events: DataFrame, query: str, *columns: str) -> DataFrame:
    hit: Column = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(c), F.lit(query.lower()))
    return events.where(hit)


def near(events: DataFrame, hit: Column, order: list[str], reach: int = 12) -> DataFrame:
    """Rows within ``reach`` places of a hit in their session: each hit names the places around it."""
    placed = running_sum(events, ["session"], order, F.lit(1), "place")
    around = F.explode(F.sequence(F.col("place") - reach, F.col("place") + reach))
    wanted = placed.where(hit).select(F.col("session").alias("s"), around.alias("p")).distinct()
    return placed.join(wanted, F.col("session").eqNullSafe(F.col("s")) & (F.col("place") == F.col("p")), "left_semi").drop("place")
