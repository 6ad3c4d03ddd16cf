"""Small helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglathe.scratch import new_path

#: The word pattern of the operators, in Java's and Python's syntax.  ``bytes.split()`` of a
#: UTF-8 text gives the same words, as it splits at exactly these six bytes.
WORD = r"[^\x20\x09-\x0D]+"
#: Sort key of rows without an id: after every other row.
NULL_ID = 2**63 - 1
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: Bytes of a word up to which workers keep what they found for it.
LONGEST_CACHED = 64

_MIX = np.uint64(0x9E3779B97F4A7C15)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared scratch folder and read it back: this cuts the
    lineage, so a lost executor does not repeat what is before it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def buckets_for(spark: SparkSession, items: int | None, most: int) -> int:
    """Buckets for ``items`` things of which one task takes about ``most``, and no fewer than the
    shuffle partitions: a task's share doesn't grow with the input."""
    return max(partitions(spark), -(-(items or 0) // most))


def small_batches(spark: SparkSession, most_bytes: int = BATCH_BYTES) -> None:
    """Arrow batches of texts hold at most ``BATCH_ROWS`` rows and ``most_bytes`` from here on, so a
    task's memory doesn't grow with the texts; a smaller setting of the session stays."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", most_bytes)):
        now = re.fullmatch(r"(-?\d+)b?", spark.conf.get(key).lower())
        if now is None or not 0 < int(now[1]) <= most:
            spark.conf.set(key, str(most))


def utf8(column: str | Column) -> Column:
    """A text column as bytes, null as empty: Arrow then hands Python the bytes undecoded."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c, F.lit("")).cast("binary")


def bounded_broadcast(df: DataFrame, most_rows: int) -> DataFrame:
    """``df`` marked for a broadcast if it has at most ``most_rows`` rows, else as it is: Spark
    then joins by a shuffle, in which skewed keys are split."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


#: Rows of one key from which ``joined_by`` deals it over several tasks.
HOT_ROWS = 1000


def joined_by(left: DataFrame, right: DataFrame, key: list[str], salt_by: list[str], name: str) -> DataFrame:
    """Inner join with ``right``, one row a key, in which no key is one task's: a key with more than
    ``HOT_ROWS`` rows of ``left`` is dealt by ``salt_by`` over that many parts, and its row of
    ``right`` is given to each.  ``left`` is read twice."""
    hot = left.groupBy(*key).agg(F.count("*").alias("salts")).where(F.col("salts") > HOT_ROWS).withColumn("salts", F.ceil(F.col("salts") / HOT_ROWS).cast("int"))
    hot = stored(hot, f"{name}-hot")
    if not hot.limit(1).count():
        return left.join(right, key)
    hot = bounded_broadcast(hot, 1_000_000)
    salts = F.coalesce("salts", F.lit(1))
    dealt = left.join(hot, key, "left").withColumn("salt", F.pmod(F.xxhash64(*salt_by), salts).cast("int")).drop("salts")
    given = right.join(hot, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return dealt.join(given, [*key, "salt"]).drop("salt")


def doc_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, text): the id (null: last) and a hash of the text.  Rows alike in both are one
    document that was given more than once."""
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("k1"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("k2"),
        utf8(text_col).alias("text"),
    )


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each ``k`` consecutive words (polynomial in the word hashes, then mixed)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for i in range(1, k):
        out *= _MIX
        out += hashes[i : i + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most_bytes: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that the texts of one hold about ``most_bytes``; a longer text is
    alone in its batch."""
    for batch in batches:
        column = batch.column(text)
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0)))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most_bytes, "right")))
            yield batch.slice(start, stop - start)
            start = stop


@lru_cache(maxsize=1)
def _trim():
    """glibc's malloc_trim, or None with another C library."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def release_memory() -> None:
    """Give the system back what this worker has freed."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def freed(run: Callable) -> Callable:
    """``run`` for mapInArrow; at the end of each task the worker gives its freed memory back.
    Spark reuses workers for all later tasks, so an executor would else hold every stage's peak."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return task


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (null id: of the empty string)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus
