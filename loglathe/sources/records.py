"""Sources of transcripts: each gives its inventory, facts and events as DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglathe.operators.archive import resume
from loglathe.operators.fold import events_of
from loglathe.schema import EVENTS, PARSER_VERSION
from loglathe.sources import ranges
from loglathe.sources.blocks import normalise_blocks
from loglathe.sources.lines import first_facts, last_speaker, manifest
from loglathe.sources.parts import high_water, normalise_parts, part_table, parts_since
from loglathe.sources.rollouts import announced, normalise_rollout


class Source(Protocol):
    """A pluggable producer of transcripts."""

    name: str

    def manifest(self) -> DataFrame:
        """(path, mtime, bytes, session)."""

    def facts(self) -> DataFrame:
        """(path, cwd, branch, assistant_last)."""

    def plan(self, sessions: DataFrame | None = None) -> DataFrame | None:
        """What a read takes of each file, from its session's cursor on; None without files."""

    def events(self, plan: DataFrame | None = None) -> DataFrame:
        """Rows of ``schema.EVENTS``."""


def _planned(manifest: DataFrame, sessions: DataFrame | None) -> DataFrame:
    """All bytes of the files, or those behind the cursors of sessions (session, cursor, parser_version)."""
    files = manifest.withColumn("start", F.lit(0).cast("long")) if sessions is None else resume(manifest, sessions, PARSER_VERSION)
    return ranges.planned(files)


def _facts(manifest: DataFrame, normalise: Callable[[DataFrame], DataFrame], dated: bool) -> DataFrame:
    """From the beginning and the end of each file only."""
    ends = last_speaker(normalise(ranges.tails(manifest)))
    return first_facts(ranges.heads(manifest, dated), dated).join(ends, "file", "left").withColumnRenamed("file", "path")


@dataclass(frozen=True)
class BlockLogs:
    """Format 1 below a folder: one folder a project, one file a session."""

    spark: SparkSession
    root: str
    name: str = "blocks"

    def manifest(self) -> DataFrame:
        return manifest(self.spark, self.root)

    def facts(self) -> DataFrame:
        return _facts(self.manifest(), normalise_blocks, dated=False)

    def plan(self, sessions: DataFrame | None = None) -> DataFrame:
        return _planned(self.manifest(), sessions)

    def events(self, plan: DataFrame | None = None) -> DataFrame:
        lines = ranges.read_ranges(self.plan() if plan is None else plan)
        return events_of(normalise_blocks(lines), self.name)


@dataclass(frozen=True)
class Rollouts:
    """Format 2 below a folder, in folders by date."""

    spark: SparkSession
    root: str
    name: str = "rollouts"

    def manifest(self) -> DataFrame:
        return manifest(self.spark, self.root, dated=True)

    def facts(self) -> DataFrame:
        return _facts(self.manifest(), normalise_rollout, dated=True)

    def plan(self, sessions: DataFrame | None = None) -> DataFrame:
        """With the session that a file announces in its first records, as a read may start behind it."""
        plan = _planned(self.manifest(), sessions)
        return plan.join(announced(ranges.heads(plan.where("error is null"), dated=True)), "path", "left")

    def events(self, plan: DataFrame | None = None) -> DataFrame:
        lines = ranges.read_ranges(self.plan() if plan is None else plan)
        return events_of(normalise_rollout(lines), self.name, orphans=False)


@dataclass(frozen=True)
class PartTables:
    """Format 3: tables of sessions, messages and parts."""

    sessions: DataFrame
    messages: DataFrame
    parts: DataFrame
    name: str = "parts"

    def manifest(self) -> DataFrame:
        sizes = self.parts.groupBy(F.col("session_id").alias("session")).agg(F.sum(F.length("data")).alias("bytes"))
        s = self.sessions.select(F.col("id").alias("session"), F.col("id").alias("path"), F.timestamp_millis("time_updated").alias("mtime"))
        return s.join(sizes, "session").select("path", "mtime", "bytes", "session")

    def facts(self) -> DataFrame:
        role = F.get_json_object("data", "$.role")
        last = self.messages.groupBy(F.col("session_id").alias("path")).agg(F.max_by(role == "assistant", F.struct("time_created", "id")).alias("assistant_last"))
        s = self.sessions.select(F.col("id").alias("path"), F.col("directory").alias("cwd"), F.lit(None).cast("string").alias("branch"))
        return s.join(last, "path", "left")

    def plan(self, sessions: DataFrame | None = None) -> None:
        return None

    def events(self, plan: DataFrame | None = None, since: DataFrame | None = None) -> DataFrame:
        """All events, or those of parts that came or changed since the marks (session, updated): the
        mark's own millisecond is read again, and sessions without a mark are read whole."""
        joined = part_table(self.parts, self.messages)
        if since is not None:
            joined = parts_since(joined, since)
        return events_of(normalise_parts(joined), self.name)

    def marks(self) -> DataFrame:
        """(session, updated): where the next read begins."""
        return high_water(part_table(self.parts, self.messages))


def read_all(spark: SparkSession, sources: Iterable[Source]) -> tuple[DataFrame, DataFrame]:
    """Events of all sources, and (source, path, error) of what can't be read: a file that can't be opened
    adds no events and stops no other file, and so does a source."""
    found, failed, files = [], [], []
    for s in sources:
        try:
            plan = s.plan()
            found.append(s.events(plan))
            if plan is not None:
                files.append(plan.where("error is not null").select(F.lit(s.name).alias("source"), "path", "error"))
        except PySparkException as e:
            failed.append((s.name, None, str(e).partition("\n")[0]))
    errors = reduce(DataFrame.unionByName, files, spark.createDataFrame(failed, "source string, path string, error string"))
    return reduce(DataFrame.unionByName, found, spark.createDataFrame([], EVENTS)), errors
