"""The condensation queue: what still needs a summary, once for each content."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglathe.functions.identity import content_hash, label, needs_model
from loglathe.functions.secrets import secret_type
from loglathe.functions.text import deflected, flatten, preview, prompt_body, tidy
from loglathe.operators.archive import current_gists, save_gists
from loglathe.schema import PROSE_LIMIT

CLAIM_SECONDS = 90
SETTLE_SECONDS = 20


def not_claimed(work: DataFrame, in_flight: DataFrame, as_of: Column) -> DataFrame:
    """Work without the hashes that another run has claimed within ``CLAIM_SECONDS``."""
    recent = in_flight.where(F.col("at") >= as_of - F.make_interval(secs=F.lit(CLAIM_SECONDS)))
    return work.join(recent.select("hash"), "hash", "left_anti")


def settled(events: DataFrame, order: list[str], as_of: Column) -> DataFrame:
    """Events without the newest one of each session that wrote anything within ``SETTLE_SECONDS``: a
    turn that is still being written would be condensed again with each block."""
    newest = events.groupBy("session").agg(F.max("ts").alias("quiet_from"), F.max_by("uid", F.struct(*order)).alias("newest"))
    young = newest.where(as_of - F.make_interval(secs=F.lit(SETTLE_SECONDS)) < F.col("quiet_from")).select("session", F.col("newest").alias("uid"))
    return events.join(young, ["session", "uid"], "left_anti")


def pending(events: DataFrame, gists: DataFrame, in_flight: DataFrame | None = None, as_of: Column | None = None) -> DataFrame:
    """(hash, kind, body) to condense: long prose without a secret, whose hash has no gist and is not
    claimed since ``CLAIM_SECONDS``; each hash once.  Give it ``settled`` events where sessions may
    still be written."""
    work = events.where(needs_model(F.col("kind")) & (F.length(flatten(preview("raw"))) > PROSE_LIMIT))
    work = work.where(secret_type("raw").isNull())
    tool = F.lit(None).cast("string")
    work = work.select(content_hash(F.col("kind"), tool, F.col("raw")).alias("hash"), "kind", prompt_body(label(F.col("kind"), tool), F.col("raw")).alias("body"))
    work = work.join(gists.select("hash"), "hash", "left_anti")
    if in_flight is not None:
        work = not_claimed(work, in_flight, as_of)
    return work.dropDuplicates(["hash"])


def opening_sentence(bodies: list[str]) -> list[str]:
    """The default condenser: each text's first sentence, no model needed."""
    out = []
    for b in bodies:
        text = b.partition("\n")[2]
        out.append(text.partition(". ")[0].strip() or text[:90])
    return out


def condense(work: DataFrame, condenser: Callable[[list[str]], list[str]] = opening_sentence) -> DataFrame:
    """(hash, gist, tok_in, tok_out) from a user's condenser, applied to batches of distinct
    contents; answers that talk to us are dropped."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            answers = condenser(f["body"].tolist())
            yield pd.DataFrame({"hash": f["hash"], "answer": answers, "tok_in": f["body"].str.split().str.len(), "tok_out": [len(a.split()) for a in answers]})

    out = work.select("hash", "body").mapInPandas(run, "hash string, answer string, tok_in long, tok_out long")
    return out.where(~deflected("answer")).select("hash", tidy("answer").alias("gist"), "tok_in", "tok_out")


def work_queue(events: DataFrame, order: list[str], log: DataFrame, in_flight: DataFrame, as_of: Column, model: str, condenser: Callable[[list[str]], list[str]] = opening_sentence) -> DataFrame:
    """One round of condensation, as rows for the log of gists: settled prose that needs a summary, holds
    no secret, has none in ``log`` and isn't claimed by another run goes through the condenser, each
    content once."""
    work = pending(settled(events, order, as_of), current_gists(log), in_flight, as_of)
    return save_gists(condense(work, condenser), model, as_of)


def with_gists(events: DataFrame, gists: DataFrame) -> DataFrame:
    """Events with their summaries by content hash; a text that holds a secret is withheld and
    never takes one.  A summary is joined, not stored, so forgetting one needs no update."""
    held = secret_type("raw").isNotNull()
    rows = events.withColumn("hash", F.when(~held, content_hash(F.col("kind"), F.lit(None).cast("string"), F.col("raw"))))
    rows = rows.join(gists.select("hash", F.col("gist").alias("model_gist")), "hash", "left")
    src = F.when(held, "withheld").when(F.col("model_gist").isNotNull(), "model").when(F.length(flatten("raw")) <= PROSE_LIMIT, "verbatim").otherwise("pending")
    return rows.withColumn("gist_src", src)


def answered(turns: DataFrame, gists: DataFrame) -> DataFrame:
    """Fused turns (gist, gist_src, hash) with the summaries that are there: only what waits takes one,
    and a text that holds a secret is withheld."""
    rows = turns.withColumn("held", secret_type("raw").isNotNull())
    rows = rows.withColumn("hash", F.when(~F.col("held"), F.col("hash")))
    rows = rows.join(gists.select("hash", F.col("gist").alias("answer")), "hash", "left")
    takes = (F.col("gist_src") == "pending") & F.col("answer").isNotNull()
    src = F.when(F.col("held") & (F.col("gist_src") == "pending"), "withheld").when(takes, "model").otherwise(F.col("gist_src"))
    return rows.withColumns({"gist": F.when(takes, F.col("answer")).otherwise(F.col("gist")), "gist_src": src}).drop("answer", "held")
