"""A stream of growing files: each batch has the whole lines that came since the batch before."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from loglathe.sources import ranges

NAME = "growing_lines"
#: Small files' ranges that one task reads, and bytes of it, at most about.
PARTITION_BYTES, PARTITION_FILES = ranges.CHUNK, 500


class Chunks(InputPartition):
    """Chunks (path, mtime, low, high, start, stop) of one task."""

    def __init__(self, chunks: list[tuple]):
        self.chunks = chunks


class Tail(DataSourceStreamReader):
    """Offsets are the byte behind the last whole line of each file.  A file that has become shorter was
    written anew and is read from its beginning; one that is gone keeps its offset.  A file that can't be
    read waits for the next batch."""

    def __init__(self, root: str):
        self.root = root
        self.known: dict[str, tuple] = {}

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        store, inner = pafs.FileSystem.from_uri(self.root) if "://" in self.root else (pafs.LocalFileSystem(), self.root.removeprefix("file:"))
        prefix = self.root[: len(self.root) - len(inner)] if "://" in self.root else ""
        for info in store.get_file_info(pafs.FileSelector(inner, recursive=True, allow_not_found=True)):
            if not info.is_file or not info.path.endswith(".jsonl"):
                continue
            path = prefix + info.path
            size, mtime, stop = self.known.get(path, (0, None, 0))
            if (info.size, info.mtime) == (size, mtime):
                continue
            try:
                with ranges.opened(path) as f:
                    self.known[path] = (info.size, info.mtime, ranges.last_line_end(f, stop if info.size >= size else 0, info.size))
            except OSError:
                continue
        return {"files": {p: [stop, mtime.timestamp()] for p, (_, mtime, stop) in sorted(self.known.items())}}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        found: list[list[tuple]] = [[]]
        size = 0
        for path, (stop, mtime) in end["files"].items():
            at = start["files"].get(path, [0])[0]
            at = 0 if at > stop else at
            for low in range(at, stop, ranges.CHUNK):
                high = min(stop, low + ranges.CHUNK)
                if found[-1] and (size + high - low > PARTITION_BYTES or len(found[-1]) >= PARTITION_FILES):
                    found.append([])
                    size = 0
                found[-1].append((path, mtime, low, high, at, stop))
                size += high - low
        return [Chunks(c) for c in found if c]

    def read(self, partition: Chunks) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for path, mtime, *places in partition.chunks:
                yield from ranges.chunk_rows(path, datetime.fromtimestamp(mtime, UTC), *places)

        yield from ranges._gathered(rows())

    def commit(self, end: dict) -> None:
        """Nothing to do: the checkpoint keeps the offsets."""


class GrowingLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return ranges.LINES

    def streamReader(self, schema) -> DataSourceStreamReader:
        return Tail(self.options["path"])


def grown(spark: SparkSession, root: str) -> DataFrame:
    """A stream of the whole lines of the ``*.jsonl`` files below ``root``, for the normalisers of
    ``sources``: (file, pos, value, file_ts, error)."""
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format(NAME).load(root)


