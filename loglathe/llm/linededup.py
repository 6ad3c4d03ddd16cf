"""Line deduplication by sharded minimal perfect hashes.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends, A-Z in lower case.  Keys of at least
``LEAST_CHARS`` code points found in at least ``LEAST_DOCS`` documents lose all their lines but those
of the largest doc_id that holds them.

1. Postings.  Each document's distinct long keys are hashed; a task packs (hash, document) by the
   hash's shard.  The number of shards grows with the measured bytes of the table.
2. Index.  Of each hash a task hands on at most the ``LEAST_DOCS`` last documents that hold it.  These lists merge
   without loss, since only "at least that many" and "the last one" are asked, so a line found in
   every document is no large group.  A shard numbers its distinct hashes by a minimal perfect hash
   (levels of bit arrays; a hash settles at the first level where it is alone) and lays out three arrays
   by that number: a 32-bit fingerprint, a count of documents that stops at ``LEAST_DOCS``, the largest
   id.
3. Probing.  Postings meet the shard's arrays, not the lines: a task reads a shard's arrays once and
   streams packed postings past them.  A shard with many postings is dealt over several tasks, each with
   its own copy of the arrays, so a hot line is split.  Hashes to drop go back to their documents.

Documents: rows alike in id and text are one document given several times, counted once, and each gets its
result; rows with one id and different texts are different documents, and all rows of the largest id keep the line.
A null id is larger than any other.  Null and empty texts are one empty line.  A very long text is one
task's, in memory in proportion to its lines.  Ties: none, as ids are compared.  Extra columns stay,
whatever their names.  An empty table gives an empty result.  Lines are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglathe.llm.common import NULL_ID, bounded_broadcast, buckets_for, chunks, doc_key, freed, read_table, small_batches, stored

LEAST_CHARS, LEAST_DOCS = 40, 5
#: Lines of a shard and postings of a probing task, about.
SHARD_LINES, PART_POSTINGS = 400_000, 1_000_000
#: Postings that a task gathers before it hands them on.
_FLUSH = 1_000_000
_SPACE = b" \t\n\x0b\x0c\r"

_MIX, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    out = (keys ^ np.uint64((seed * 0xA24BAED4963EE407 + 0x9FB21C651E98DF25) % 2**64)) * _MIX
    out ^= out >> np.uint64(32)
    out *= _TURN
    out ^= out >> np.uint64(29)
    return out


class PerfectHash:
    """Numbers 0 .. n-1 for ``n`` distinct 64-bit keys.  Level i has a bit for each place; a key's bit is
    set at the first level where no other key has its place, and its number is the rank of that
    bit.  Any other key gets some number or -1."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.starts = np.concatenate([[0], np.cumsum(sizes // 64)]).astype(np.int64)
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        sizes, words = [], []
        while len(keys):
            size = -(-2 * len(keys) // 64) * 64
            at = (_mixed(keys, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            keys = keys[~alone[at]]
        return cls(np.array(sizes, np.int64), np.concatenate(words) if words else np.empty(0, np.uint64))

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = (_mixed(keys[left], level) % np.uint64(size)).astype(np.int64)
            word, bit = self.starts[level] + (at >> 6), (at & 63).astype(np.uint64)
            here = (self.words[word] >> bit) & np.uint64(1) == 1
            before = self.words[word[here]] & ((np.uint64(1) << bit[here]) - np.uint64(1))
            out[left[here]] = self.ranks[word[here]] + np.bitwise_count(before)
            left = left[~here]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mixed(keys, 0xF1) >> np.uint64(32)).astype(np.uint32)


def line_keys(text: bytes) -> list[bytes]:
    return [line.strip(_SPACE).lower() for line in text.split(b"\n")]


def is_long(key: bytes) -> bool:
    return len(key) >= LEAST_CHARS and (len(key) >= 4 * LEAST_CHARS or len(key.decode("utf-8", "replace")) >= LEAST_CHARS)


def _hashes(text: bytes) -> np.ndarray:
    """Distinct hashes of the text's long keys."""
    return np.array(sorted({xxhash.xxh64_intdigest(k) for k in line_keys(text) if is_long(k)}), np.uint64)


_POSTINGS = "shard int, n long, hashes binary, k1s binary, k2s binary"
_FIELDS = [("hashes", np.uint64), ("k1s", np.int64), ("k2s", np.int64)]


def _by_shard(shard: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """One row for each shard, with its part of each column as bytes."""
    order = np.argsort(shard, kind="stable")
    shard = shard[order]
    cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
    ends = np.append(cuts[1:], len(shard))
    arrays = [pa.array(shard[cuts].astype(np.int32)), pa.array(ends - cuts, pa.int64())]
    for c in columns:
        c = c[order]
        arrays.append(pa.array([c[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in _POSTINGS.split(", ")])


def _post(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            h, k1, k2 = (np.concatenate(x) for x in zip(*held, strict=True))
            return _by_shard((h >> np.uint64(33)).astype(np.int64) % shards, [h, k1, k2])

        for batch in chunks(batches):
            for k1, k2, text in zip(*[batch.column(c).to_pylist() for c in ("k1", "k2", "text")], strict=True):
                if len(text) >= LEAST_CHARS and len(found := _hashes(text)):
                    held.append((found, np.full(len(found), k1), np.full(len(found), k2)))
                    size += len(found)
            if size >= _FLUSH:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return run


def postings(docs: DataFrame, shards: int) -> DataFrame:
    """Packed (hash, document) of every document's distinct long lines, by shard, stored."""
    return stored(doc_key(docs).mapInArrow(freed(_post(shards)), _POSTINGS), "line-postings")


def _last_documents(h: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, document), of each hash the last ``LEAST_DOCS``; and each one's place from the
    end among those of its hash."""
    order = np.lexsort((k2, k1, h))[::-1]
    h, k1, k2 = h[order], k1[order], k2[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
    h, k1, k2 = h[new], k1[new], k2[new]
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    place = np.arange(len(h)) - np.repeat(starts, np.diff(np.append(starts, len(h))))
    stay = place < LEAST_DOCS
    return h[stay], k1[stay], k2[stay], place[stay]


def _arrays(table: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, ...]:
    return tuple(np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in _FIELDS)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shards = batch.column("shard").to_pylist()
        for i, shard in enumerate(shards):
            h, k1, k2, _ = _last_documents(*_arrays(batch.slice(i, 1)))
            yield _by_shard(np.full(len(h), shard), [h, k1, k2])


_INDEX = "shard int, sizes binary, words binary, prints binary, counts binary, largest binary"


def _index(table: pa.Table) -> pa.Table:
    """The arrays of one shard."""
    h, k1, _, place = _last_documents(*_arrays(table))
    first = np.flatnonzero(place == 0)
    keys = h[first]
    last = np.append(first[1:], len(h)) - 1
    phf = PerfectHash.of(keys)
    at = phf.numbers(keys)
    prints, counts, largest = np.empty(len(keys), np.uint32), np.empty(len(keys), np.uint8), np.empty(len(keys), np.int64)
    prints[at], counts[at], largest[at] = fingerprints(keys), place[last] + 1, k1[first]
    blobs = [x.tobytes() for x in (phf.sizes, phf.words, prints, counts, largest)]
    return pa.Table.from_arrays([table.column("shard").slice(0, 1), *[pa.array([b], pa.binary()) for b in blobs]], names=[x.split()[0] for x in _INDEX.split(", ")])


def index(posted: DataFrame) -> DataFrame:
    """(shard, arrays of its perfect hash, fingerprints, counts and largest ids), stored."""
    summed = posted.mapInArrow(freed(_summaries), _POSTINGS)
    return stored(summed.groupBy("shard").applyInArrow(_index, _INDEX), "line-index")


class Arrays:
    """A shard's arrays, ready to be probed."""

    def __init__(self, row: dict):
        self.phf = PerfectHash(np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["words"], np.uint64))
        self.prints, self.counts, self.largest = (np.frombuffer(row[c], t) for c, t in (("prints", np.uint32), ("counts", np.uint8), ("largest", np.int64)))

    def drops(self, hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether each line goes from the document with that id."""
        at = self.phf.numbers(hashes)
        known = at >= 0
        at = np.where(known, at, 0)
        known &= self.prints[at] == fingerprints(hashes)
        return known & (self.counts[at] >= LEAST_DOCS) & (ids < self.largest[at])


_DROPS = "k1 long, k2 long, drops binary"


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by shard and part, a shard's arrays before its postings."""
    arrays, shard = None, None
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            if row["words"] is not None:
                arrays, shard = Arrays(row), row["shard"]
                continue
            if shard != row["shard"]:
                raise ValueError("postings without their shard's arrays")
            h, k1, k2 = (np.frombuffer(row[c], t) for c, t in _FIELDS)
            gone = np.flatnonzero(arrays.drops(h, k1))
            if not len(gone):
                continue
            gone = gone[np.lexsort((k2[gone], k1[gone]))]
            a, b = k1[gone], k2[gone]
            starts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            ends = np.append(starts[1:], len(gone))
            cut = [h[gone[s:e]].tobytes() for s, e in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(a[starts]), pa.array(b[starts]), pa.array(cut, pa.binary())], ["k1", "k2", "drops"])


def probed(posted: DataFrame, arrays: DataFrame) -> DataFrame:
    """(k1, k2, drops): hashes of the lines that go from a document, packed; a document has a row
    for each shard and task that found some."""
    sizes = posted.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", F.ceil(F.col("n") / PART_POSTINGS).cast("int").alias("parts"))
    sizes = bounded_broadcast(stored(sizes, "line-parts"), 1_000_000)
    given = arrays.join(sizes, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    dealt = posted.join(sizes, "shard").withColumn("part", F.pmod(F.xxhash64("hashes", "k1s", "k2s"), F.col("parts")).cast("int")).drop("parts", "n")
    both = given.unionByName(dealt, allowMissingColumns=True)
    tasks = buckets_for(posted.sparkSession, sizes.agg(F.sum("parts")).first()[0], 1)
    both = both.repartition(tasks, "shard", "part").sortWithinPartitions("shard", "part", F.col("words").isNull())
    return both.mapInArrow(freed(_probe), _DROPS)


def _kept(fields: list[str], text_at: int):
    """Each document without the lines whose hashes are in ``_drops``, with its counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text=fields[text_at]):
            texts, counts, dropped = [], [], []
            for text, drops in zip(batch.column(text_at).to_pylist(), batch.column("_drops").to_pylist(), strict=True):
                if not drops:
                    texts.append(text)
                    counts.append((text or b"").count(b"\n") + 1)
                    dropped.append(0)
                    continue
                gone = set(np.frombuffer(b"".join(drops), np.uint64).tolist())
                lines = text.split(b"\n")
                stay = [line for line, key in zip(lines, line_keys(text), strict=True) if not (is_long(key) and xxhash.xxh64_intdigest(key) in gone)]
                texts.append(b"\n".join(stay))
                counts.append(len(lines))
                dropped.append(len(lines) - len(stay))
            columns = [pa.array(texts, pa.binary()) if i == text_at else batch.column(i) for i in range(len(fields))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())], [*fields, "_n_lines", "_n_dropped"])

    return run


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with its repeated lines dropped from the texts, and ``_n_lines`` and ``_n_dropped``."""
    spark = docs.sparkSession
    small_batches(spark)
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    posted = postings(docs, buckets_for(spark, (n_bytes or 0) // LEAST_CHARS, SHARD_LINES))
    drops = probed(posted, index(posted)).groupBy("k1", "k2").agg(F.collect_list("drops").alias("_drops"))
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_k1"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_k2")]
    at = docs.columns.index("text")
    joined = docs.select(*[F.col(c).cast("binary") if c == "text" else c for c in docs.columns], *key)
    joined = joined.join(drops.withColumnsRenamed({"k1": "_k1", "k2": "_k2"}), ["_k1", "_k2"], "left").select(*docs.columns, "_drops")
    schema = ", ".join(f"`{f.name}` {'binary' if f.name == 'text' else f.dataType.simpleString()}" for f in docs.schema)
    out = joined.mapInArrow(freed(_kept(docs.columns, at)), f"{schema}, _n_lines long, _n_dropped long")
    return out.withColumn("text", F.col("text").cast("string"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicated(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
