"""Files of JSON lines: inventory, lines, parsed records, and what a file says about its session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a normalised row: events, and tool results (kind ``result``) that ``operators.fold``
#: joins to their calls; ``hint`` is a result's few words.
ROW = ["file", "session", "pos", "sub", "uid", "ts", "ts_missing", "role", "kind", "tool", "raw", "gist", "gist_src", "hint", "call_id", "is_call", "is_error", "tokens"]


def manifest(spark: SparkSession, root: str, dated: bool = False) -> DataFrame:
    """(path, mtime, bytes, session) of the transcripts below ``root``, newest first; contents aren't
    read, empty files are left out.  The session is the file's stem, in the layout by dates the last
    part of it if that has eight bytes."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", True).load(root)
    stem = F.regexp_extract("path", r"([^/]+)\.jsonl$", 1)
    last = F.element_at(F.split(stem, "-"), -1)
    session = F.when(F.octet_length(last) >= 8, last).otherwise(stem) if dated else stem
    out = df.where(F.col("length") > 0).select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("bytes"), session.alias("session"))
    return out.orderBy(F.desc("mtime"), "path")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, value, file_ts) of every line, in an order that holds within a file, by Spark's own text
    reader.  A file that can't be read is an error here; ``ranges`` tells files apart."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(path)
    order = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return df.select(F.col("_metadata.file_path").alias("file"), order.alias("pos"), "value", F.col("_metadata.file_modification_time").alias("file_ts"))


def string_of(v: Column, path: str) -> Column:
    """The string at a path, null for any other type."""
    at = F.try_variant_get(v, f"$.{path}", "variant")
    return F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get(v, f"$.{path}", "string"))


def flag_of(v: Column, path: str) -> Column:
    at = F.try_variant_get(v, f"$.{path}", "variant")
    return F.coalesce((F.schema_of_variant(at) == "BOOLEAN") & F.try_variant_get(v, f"$.{path}", "boolean"), F.lit(False))


def texts_of(v: Column, path: str) -> Column:
    """A string, or the texts of an array of blocks joined by line ends; else empty."""
    blocks = F.try_variant_get(v, f"$.{path}", "array<struct<text: string>>")
    return F.coalesce(string_of(v, path), F.array_join(F.transform(blocks, lambda b: b.text), "\n"), F.lit(""))


def stem_of(file: Column) -> Column:
    return F.regexp_extract(file, r"([^/]+?)(\.jsonl)?$", 1)


def parsed(lines: DataFrame) -> DataFrame:
    """``lines`` with ``v``, their JSON; lines that aren't JSON are left out, so a torn last line waits
    for the next read.  A missing time becomes the file's, and ``ts_missing`` says so."""
    v = lines.withColumn("v", F.try_parse_json("value")).where(F.col("v").isNotNull())
    ts = F.try_to_timestamp(string_of(F.col("v"), "timestamp"))
    return v.withColumns({"ts_missing": ts.isNull(), "ts": F.coalesce(ts, F.col("file_ts"))})


def shaped(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` in the columns of ``ROW``; those not given or there are empty."""
    none = F.lit(None).cast("string")
    empty = {"sub": F.lit(0), "tool": none, "hint": none, "call_id": F.lit(""), "is_call": F.lit(False), "is_error": F.lit(False), "tokens": F.lit(0).cast("long")}
    return rows.select(*[(columns[c] if c in columns else F.col(c) if c in rows.columns else empty[c]).alias(c) for c in ROW])


def first_facts(head: DataFrame, dated: bool = False) -> DataFrame:
    """(file, cwd, branch) from the first records of each file (``ranges.heads``): the first of each that
    there is, or in the layout by dates those of the first announcement.  ``HEAD`` is no branch."""
    n, v = F.col("pos.line"), F.col("v")
    rows = head.withColumn("v", F.try_parse_json("value"))
    cwd, branch = (string_of(v, p) for p in (("payload.cwd", "payload.git.branch") if dated else ("cwd", "gitBranch")))
    branch = F.when(~branch.isin("", "HEAD"), branch)
    if dated:
        meta = F.when(string_of(v, "type") == "session_meta", n)
        return rows.groupBy("file").agg(F.min_by(cwd, meta).alias("cwd"), F.min_by(branch, meta).alias("branch"))
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), n))
    return rows.groupBy("file").agg(first(cwd).alias("cwd"), first(branch).alias("branch"))


def last_speaker(rows: DataFrame) -> DataFrame:
    """(file, assistant_last) of normalised rows: who spoke last, null if nobody did."""
    at = F.when(F.col("kind").isin("prompt", "say"), F.struct("pos", "sub"))
    return rows.groupBy("file").agg(F.max_by(F.col("kind") == "say", at).alias("assistant_last"))
