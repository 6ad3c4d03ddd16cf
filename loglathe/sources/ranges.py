"""Readers of byte ranges: only what is new in a file, its beginning, or its end.

``planned`` fixes what a read takes: of each file the bytes from ``start`` to the end of its last
whole line, found by reading back from the file's end.  So a half-written line waits for the next
read, a read that is repeated takes the same bytes, and ``stop`` is the cursor to keep with the rows.
Ranges are cut into chunks that are dealt over tasks, wherever lines end.  A file that can't be opened
has an ``error`` in the plan and stops no other.  Bytes that are no UTF-8 become replacement characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglathe.scratch import new_path

CHUNK, BLOCK, TAIL = 64 << 20, 1 << 20, 96 << 10
#: Files that one task opens at most, about, and bytes of lines in a batch.
TASK_FILES, BATCH_BYTES = 500, 4 << 20
HEAD_LINES, DATED_LINES = 400, 40

PLAN = "path string, mtime timestamp, start long, stop long, error string"
LINES = "file string, pos struct<block: bigint, line: bigint>, value string, file_ts timestamp, error string, session string"
_CHUNK = "path string, mtime timestamp, start long, stop long, low long, high long, session string"
_POS = pa.struct([("block", pa.int64()), ("line", pa.int64())])
_ARROW = pa.schema([("file", pa.string()), ("pos", _POS), ("value", pa.string()), ("file_ts", pa.timestamp("us", "UTC")), ("error", pa.string()), ("session", pa.string())])


def opened(path: str) -> pa.NativeFile:
    """A file by its path or address, in whatever store it is, to be read from any place."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        return pafs.LocalFileSystem().open_input_file(path)
    store, inner = pafs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def last_line_end(f: BinaryIO, start: int, size: int) -> int:
    """Where the last whole line of bytes ``start`` to ``size`` ends: behind its line end, or ``start``."""
    at = size
    while at > start:
        low = max(start, at - BLOCK)
        f.seek(low)
        found = f.read(at - low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        at = low
    return start


def lines_between(f: BinaryIO, low: int, high: int, stop: int, whole: bool) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin at ``low`` or behind and before ``high``; the last may go on up
    to ``stop``.  Unless a line begins at ``low`` (``whole``), what is left of the line before is skipped."""
    at = low if whole else max(0, low - 1)
    f.seek(at)
    rest, skip = b"", not whole
    while at < high or rest or skip:
        data = f.read(min(BLOCK, stop - at - len(rest)))
        if not data:
            break
        parts = (rest + data).split(b"\n")
        rest = parts.pop()
        for part in parts:
            if not skip and at < high:
                yield at, part
            skip = False
            at += len(part) + 1
        if at >= high:
            return
    if rest and not skip and at < high:
        yield at, rest


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    file, block, line, value, ts, error, session = zip(*rows, strict=True)
    pos = pa.StructArray.from_arrays([pa.array(block, pa.int64()), pa.array(line, pa.int64())], ["block", "line"])
    return pa.RecordBatch.from_arrays([pa.array(file), pos, pa.array(value, pa.string()), pa.array(ts, _ARROW.field("file_ts").type), pa.array(error, pa.string()), pa.array(session, pa.string())], schema=_ARROW)


def _gathered(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 100 + len(row[3] or "")
        if size >= BATCH_BYTES:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def chunk_rows(path: str, mtime, low: int, high: int, start: int, stop: int, session: str | None = None) -> Iterator[tuple]:
    """(file, block, line, value, file_ts, error, session) of one chunk.  ``block`` is where it begins."""
    try:
        with opened(path) as f:
            for at, line in lines_between(f, low, high, stop, low == start):
                yield path, low, at, line.decode("utf-8", "replace").rstrip("\r"), mtime, None, session
    except OSError as e:
        yield path, low, -1, None, mtime, f"{type(e).__name__}: {e}".partition("\n")[0], session


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        stops, errors = [], []
        for path, start, size in zip(*[batch.column(c).to_pylist() for c in ("path", "start", "bytes")], strict=True):
            stop, error = start, None
            try:
                with opened(path) as f:
                    stop = last_line_end(f, start, min(size, f.size()))
            except OSError as e:
                error = f"{type(e).__name__}: {e}".partition("\n")[0]
            stops.append(stop)
            errors.append(error)
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("path", "mtime", "start")] + [pa.array(stops, pa.int64()), pa.array(errors, pa.string())], ["path", "mtime", "start", "stop", "error"])


def planned(files: DataFrame) -> DataFrame:
    """(path, mtime, start, stop, error) of files (path, mtime, bytes, start), written down so that a
    file which grows meanwhile changes nothing."""
    spark = files.sparkSession
    rows = files.select("path", "mtime", F.col("start").cast("long").alias("start"), F.col("bytes").cast("long").alias("bytes"))
    tasks = max(1, -(-rows.count() // TASK_FILES))
    path = new_path(spark, "read-plan")
    rows.repartition(max(tasks, spark.sparkContext.defaultParallelism)).mapInArrow(_probe, PLAN).write.parquet(path)
    return spark.read.schema(PLAN).parquet(path)


def _read(strict: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for r in batch.to_pylist():
                    for row in chunk_rows(r["path"], r["mtime"], r["low"], r["high"], r["start"], r["stop"], r["session"]):
                        if strict and row[5]:
                            raise OSError(f"{row[0]} was planned to be read to byte {r['stop']}: {row[5]}")
                        yield row

        yield from _gathered(rows())

    return run


def read_ranges(plan: DataFrame, strict: bool = True) -> DataFrame:
    """Lines of planned ranges: (file, pos, value, file_ts, error, session), the session if the plan has
    one.  ``pos`` orders a file's lines by their bytes.  A file that fails after it was planned fails the read, as its cursor must not go on
    without its lines; unless ``strict``, it has a row with the error for each such chunk."""
    spark = plan.sparkSession
    total, files = plan.where("error is null").agg(F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0)), F.count("*")).first()
    lows = F.sequence(F.col("start"), F.col("stop") - 1, F.lit(CHUNK).cast("long"))
    named = plan if "session" in plan.columns else plan.withColumn("session", F.lit(None).cast("string"))
    chunks = named.where("error is null AND stop > start").withColumn("low", F.explode(lows)).withColumn("high", F.least(F.col("low") + CHUNK, F.col("stop")))
    tasks = max(-(-total // CHUNK), -(-files // TASK_FILES), min(files, spark.sparkContext.defaultParallelism), 1)
    return chunks.select(*[c.split()[0] for c in _CHUNK.split(", ")]).repartition(tasks).mapInArrow(_read(strict), LINES)


def failures(plan: DataFrame, rows: DataFrame) -> DataFrame:
    """(path, error) of files that could not be read, in the plan or while their lines were read."""
    late = rows.where("error is not null").select(F.col("file").alias("path"), "error")
    return plan.where("error is not null").select("path", "error").unionByName(late).groupBy("path").agg(F.min("error").alias("error"))


def head_lines(f: BinaryIO, most: int) -> Iterator[tuple[int, bytes]]:
    """(number, line) of a file's first ``most`` lines; reading ends with the last."""
    rest, n = b"", 0
    while data := f.read(64 << 10):
        parts = (rest + data).split(b"\n")
        rest = parts.pop()
        for part in parts:
            n += 1
            yield n, part
            if n == most:
                return
    if rest:
        yield n + 1, rest


def tail_lines(f: BinaryIO, size: int) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin in a file's last ``TAIL`` bytes; one cut in two is left out."""
    low = max(0, size - TAIL)
    f.seek(low)
    parts = f.read(size - low).split(b"\n")
    at = low
    for i, part in enumerate(parts):
        if part and not (i == 0 and low):
            yield at, part
        at += len(part) + 1


def _ends(most: int | None):
    """Head lines (numbered from 1) or, without ``most``, tail lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for path, mtime in zip(batch.column("path").to_pylist(), batch.column("mtime").to_pylist(), strict=True):
                    try:
                        with opened(path) as f:
                            for at, line in head_lines(f, most) if most else tail_lines(f, f.size()):
                                yield path, 0, at, line.decode("utf-8", "replace"), mtime, None, None
                    except OSError as e:
                        yield path, 0, -1, None, mtime, f"{type(e).__name__}: {e}".partition("\n")[0], None

        yield from _gathered(rows())

    return run


def _of_files(files: DataFrame, most: int | None) -> DataFrame:
    tasks = max(1, -(-files.count() // TASK_FILES), files.sparkSession.sparkContext.defaultParallelism)
    return files.select("path", "mtime").repartition(tasks).mapInArrow(_ends(most), LINES)


def heads(files: DataFrame, dated: bool = False) -> DataFrame:
    """The first records of each file (path, mtime), with their number as ``pos.line``; many files are one
    task's, and what is read doesn't grow with a file."""
    return _of_files(files, DATED_LINES if dated else HEAD_LINES)


def tails(files: DataFrame) -> DataFrame:
    """The lines in each file's last ``TAIL`` bytes."""
    return _of_files(files, None)
