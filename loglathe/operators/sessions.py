"""Sessions: their span, siblings and choice, and rows that belong to a session or a feed row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loglathe.operators.pieces import next_value, running_sum


def span(events: DataFrame) -> DataFrame:
    """(session, first_ts, last_ts)."""
    return events.groupBy("session").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def known(sessions: DataFrame) -> DataFrame:
    """Sessions that were read at least once."""
    return sessions.where(F.col("seen") > 0)


def by_prefix(sessions: DataFrame, prefix: str, order: list[Column]) -> DataFrame:
    """The first session by ``order`` whose id begins with ``prefix``."""
    return sessions.where(F.startswith(F.col("id").cast("string"), F.lit(prefix))).orderBy(*order).limit(1)


def narrowed(sessions: DataFrame, text: str) -> DataFrame:
    """Sessions with ``text`` in their project, tag or source, in any case."""
    hits = [F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(text.strip().lower())), F.lit(False)) for c in ("project", "tag", "source")]
    return sessions.where(hits[0] | hits[1] | hits[2])


def default(sessions: DataFrame, here: Column, order: list[Column]) -> DataFrame:
    """The session to open: the first by ``order`` where ``here`` holds, else the first of all."""
    return sessions.orderBy(F.desc(F.coalesce(here, F.lit(False))), *order).limit(1)


def peers(sessions: DataFrame, live: Column) -> DataFrame:
    """(id, peers, live_peers): the other sessions of each one's project.  The projects are counted
    first, so a project of any size is one small row in the join."""
    rows = sessions.select("id", "project", F.coalesce(live, F.lit(False)).cast("int").alias("live"))
    counts = rows.groupBy("project").agg(F.count("*").alias("n"), F.sum("live").alias("m"))
    joined = rows.alias("r").join(counts.alias("c"), F.col("r.project").eqNullSafe(F.col("c.project")))
    return joined.select("id", (F.col("n") - 1).alias("peers"), (F.col("m") - F.col("live")).alias("live_peers"))


def carried(rows: DataFrame, key: str, value: Column, name: str, order: list[str]) -> DataFrame:
    """``rows`` with the last ``value`` announced so far among those of the same ``key``."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def shown_at(events: DataFrame, row_kinds: list[str], order: list[str]) -> DataFrame:
    """``events`` with ``row``: the uid of the feed row that shows each.  A say is shown at the last
    say before the next prompt or note; any other event at the next row from it on (kinds
    ``row_kinds``, and those last says), null after the last."""
    rows = running_sum(events, ["session"], order, F.col("kind").isin("prompt", "note").cast("int"), "run")
    says = Window.partitionBy("session", "run").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    said = F.when(F.col("kind") == "say", F.col("uid"))
    rows = rows.withColumn("fused", F.last(said, ignorenulls=True).over(says))
    is_row = F.col("kind").isin(*row_kinds) | ((F.col("kind") == "say") & (F.col("uid") == F.col("fused")))
    rows = next_value(rows, ["session"], order, F.when(is_row, F.col("uid")), "after")
    return rows.withColumn("row", F.when(F.col("kind") == "say", F.col("fused")).otherwise(F.col("after"))).drop("run", "fused", "after")
