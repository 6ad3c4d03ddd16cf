"""N-gram Jaccard join by grouped prefixes, and the classes that its links form.

A document's set holds its distinct ``GRAM``-word shingles (A-Z lower-cased; the whole sequence if
it has fewer words), as 64-bit hashes.  Two documents link when 100 * |intersection| >= ``PERCENT``
* |union|.  Then each holds at least ``PERCENT`` % of the other's set, which gives three exact
filters:

1. Partner test.  Shingles with a hash below ``SAMPLE`` of the range are dealt to buckets, and a
   bucket tells which occur in two documents or more.  A set of n shingles can miss only
   n - ceil(0.8 n) of them in a partner, so a document goes on only if its sampled shingles that
   occur once are at most as many.  Most texts without a near copy end here.
2. Prefixes.  Shingles are ordered by rarity (from a histogram of fixed size) and hash; linked sets
   share one of their first n - ceil(0.8 n) + 1.  Documents with equal prefix and size form a
   group, and groups stand in the lists of their prefix shingles.
3. Sizes and places: n <= 1.25 m, and enough shingles after the shared one to reach the overlap.

First each member is compared with its group's first and each group with one hub of its lists (that
with most lists in common), again and again with other hubs while this brings links; components are
formed from the links.  What they leave is found by a last pass over the lists, in which the members
of a group that are in one component stand as one entry.  Every pair of entries of different
components that the filters admit is verified by the entries' first members; pairs still apart are
then expanded, and all pairs of their members verified.  So no link between components is lost, and
pairs inside a large group of near copies are not enumerated.  A list of more than ``LONG`` entries
is cut into blocks, and each two blocks are compared in a task of their own.

``op5_ngram_jaccard_join`` then counts every link of a document: other documents of a set equal to
its own, and those of each set that links with it.  All links lie inside components, so the
distinct sets of a component are compared each with each: a large component is dealt by size class
and hash into blocks, and each two blocks that can hold a link meet in one task.

Copies of a whole text are joined beforehand and share their class.  Joins on keys that can be hot
(a text's hash, a group, a hub) are salted.  A text of any length is one task's, in memory in
proportion to its words; extra columns are not read, whatever their names.  Ties are broken by id
and text.  Nulls: a null text is empty
and linked with nothing; a null id comes after all others and is the class id only of rows that
have no other.  Rows with the same id and text are one document given several times.  An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loglathe.llm.common import NULL_ID, bounded_broadcast, buckets_for, chunks, doc_key, freed, joined_by, partitions, read_table, small_batches, stored, window_hashes, word_hashes
from loglathe.llm.components import components, joined

GRAM, PERCENT = 5, 80
SAMPLE = 1 / 3
_FLUSH = 500_000
#: Sampled shingles and prefix shingles that a bucket holds, about.
BUCKET_SAMPLES, BUCKET_POSTINGS = 4_000_000, 2_000_000
#: Entries of a list that one task compares, and of each block of a longer one.
LONG, LIST_BLOCK = 4_000, 2_000
#: Cells of the rarity histogram, and cells in a block of it.
CELLS, CELL_BLOCK = 1 << 20, 1 << 14


def shingles(text: bytes) -> np.ndarray:
    """The sorted hashes of a text's set."""
    words = text.lower().split()
    if len(words) >= GRAM:
        return np.unique(window_hashes(word_hashes(words), GRAM))
    return np.array([xxhash.xxh64_intdigest(b" ".join(words))] if words else [], np.uint64)


def may_miss(n: int) -> int:
    """Shingles of a set of n that a linked set may lack."""
    return n - -(-n * PERCENT // 100)


def overlap_needed(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return -(-PERCENT * (n + m) // (100 + PERCENT))


# --- 1. partner test


_BLOCK = "bucket int, kds binary, counts binary, hashes binary, docs binary"


def _deal_sample(buckets: int):
    limit = np.uint64(int(SAMPLE * 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray]] = []
        facts: list[tuple[int, int, int]] = []
        size = turn = 0

        def flush(turn: int) -> pa.RecordBatch:
            hashes = np.concatenate([h for _, h in held] or [np.empty(0, np.uint64)])
            kd = np.repeat(np.array([k for k, _ in held], np.int64), [len(h) for _, h in held])
            bucket = (hashes % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = [(turn % buckets, b"", b"", b"", np.array(facts, np.int64).tobytes())]
            for b in np.flatnonzero(np.diff(cuts)):
                own = order[cuts[b] : cuts[b + 1]]
                of = kd[own]
                new = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                rows.append((int(b), of[new].tobytes(), np.diff(np.append(new, len(of))).astype(np.uint32).tobytes(), hashes[own].tobytes(), b""))
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], [x.split()[0] for x in _BLOCK.split(", ")])

        for batch in chunks(batches):
            for kd, copy, text in zip(batch.column("kd").to_pylist(), batch.column("copies").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if copy:
                    continue
                found = shingles(text)
                sample = found[: np.searchsorted(found, limit)]
                facts.append((kd, len(found), len(sample)))
                held.append((kd, sample))
                size += len(sample)
            if size >= _FLUSH:
                yield flush(turn)
                held, facts, size, turn = [], [], 0, turn + 1
        if facts:
            yield flush(turn)

    return run


def _twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kd, recurring, n, sampled): for one bucket the number of a document's shingles that others
    have too; n and sampled once for each document."""
    names = ["kd", "recurring", "n", "sampled"]
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        for kds, counts, hashes, docs in zip(*[batch.column(c).to_pylist() for c in ("kds", "counts", "hashes", "docs")], strict=True):
            if docs:
                facts = np.frombuffer(docs, np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (facts[:, 0], np.zeros(len(facts), np.int64), facts[:, 1], facts[:, 2])], names)
            if kds:
                parts.append((np.repeat(np.frombuffer(kds, np.int64), np.frombuffer(counts, np.uint32)), np.frombuffer(hashes, np.uint64)))
    if not parts:
        return
    kd, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    order = np.argsort(hashes)
    same = hashes[order[1:]] == hashes[order[:-1]]
    order = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
    order = order[np.lexsort((kd[order], hashes[order]))]
    if not len(order):
        return
    k, h = kd[order], hashes[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (h[1:] != h[:-1])])  # a row given twice counts once
    k, h = k[new], h[new]
    group = np.concatenate([[0], np.cumsum(h[1:] != h[:-1])])
    k, c = np.unique(k[np.bincount(group)[group] > 1], return_counts=True)
    for i in range(0, len(k), 50_000):
        part = c[i : i + 50_000].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k[i : i + 50_000], part, np.zeros(len(part), np.int64), np.zeros(len(part), np.int64))], names)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The set of each document that passed; others without it."""
    for batch in chunks(batches):
        rows: list[tuple] = []
        for kd, k1, k2, n, passed, text in zip(*[batch.column(c).to_pylist() for c in ("kd", "k1", "k2", "n", "passed", "text")], strict=True):
            if n is not None:
                rows.append((kd, k1, k2, n, shingles(text).tobytes() if passed else None))
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["kd", "k1", "k2", "n", "tokens"])


def contents(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, kd, content, bytes) of each row, without its text."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    k1 = F.coalesce("doc_id", F.lit(NULL_ID))
    k2 = F.xxhash64(F.coalesce("text", F.lit("")))
    return keyed.select("doc_id", k1.alias("k1"), k2.alias("k2"), F.xxhash64(k1, k2).alias("kd"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("content"), F.octet_length(F.coalesce("text", F.lit(""))).alias("bytes"))


def sets_of(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Stored (kd, k1, k2, n, tokens) of each distinct text: tokens is null where the partner test
    excludes a link."""
    small_batches(docs.sparkSession)
    # A word takes about six bytes, and the copies' shingles aren't dealt, so this is rather too many.
    n = buckets_for(docs.sparkSession, int((rows.agg(F.sum("bytes")).first()[0] or 0) * SAMPLE / 6), BUCKET_SAMPLES)
    base = doc_key(docs).select(F.xxhash64("k1", "k2").alias("kd"), "k1", "k2", "text")
    first = rows.groupBy("content").agg(F.min("k1").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = joined_by(rows.select("content", "k1", "kd"), first, ["content"], ["kd"], "copies").where(F.col("k1") > F.col("first")).groupBy("kd").agg(F.count("*").alias("copies"))
    by_kd = lambda right: base.join(right.hint("shuffle_hash"), "kd", "left")
    dealt = by_kd(copies).mapInArrow(freed(_deal_sample(n)), _BLOCK).repartitionById(n, "bucket")
    seen = dealt.mapInArrow(freed(_twice), "kd long, recurring long, n long, sampled long")
    facts = seen.groupBy("kd").agg(F.sum("recurring").alias("recurring"), F.max("n").alias("n"), F.max("sampled").alias("sampled"))
    lacking = F.col("n") - F.ceil(F.col("n") * PERCENT / 100)
    facts = facts.select("kd", "n", ((F.col("n") > 0) & (F.col("sampled") - F.col("recurring") <= lacking)).alias("passed"))
    out = by_kd(facts).mapInArrow(freed(_sets), "kd long, k1 long, k2 long, n long, tokens binary")
    return stored(out, "sets").dropDuplicates(["kd"])


# --- 2. prefixes


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(CELLS, np.int64)
    for batch in batches:
        for tokens in batch.column("tokens").to_pylist():
            np.add.at(counts, (np.frombuffer(tokens, np.uint64) >> np.uint64(44)).astype(np.int64), 1)
    for b in range(CELLS // CELL_BLOCK):
        block = counts[b * CELL_BLOCK : (b + 1) * CELL_BLOCK]
        if block.any():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([block.tobytes()], pa.binary())], ["block", "counts"])


def _merge(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist())
    level = np.array([int(c).bit_length() for c in total], np.uint8)
    return pa.table({"block": table.column("block")[:1], "levels": pa.array([level.tobytes()], pa.binary())})


def rarity(tokens: DataFrame) -> np.ndarray:
    """For each cell of token hashes the bits of its count: one byte each, whatever the input."""
    blocks = tokens.select("tokens").mapInArrow(freed(_histogram), "block int, counts binary").groupBy("block").applyInArrow(_merge, "block int, levels binary")
    out = np.zeros(CELLS, np.uint8)
    for row in blocks.collect():  # CELLS bytes at most
        out[row.block * CELL_BLOCK : (row.block + 1) * CELL_BLOCK] = np.frombuffer(row.levels, np.uint8)
    return out


def prefix(tokens: np.ndarray, levels: np.ndarray) -> np.ndarray:
    cell = levels[(tokens >> np.uint64(44)).astype(np.int64)]
    return tokens[np.lexsort((tokens, cell))[: may_miss(len(tokens)) + 1]]


@dataclass(frozen=True)
class Postings:
    """Deals prefix shingles to buckets.  Each is (token, place, n, node, label)."""

    buckets: int
    levels: object  # a broadcast of ``rarity``

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = self.levels.value
        for batch in chunks(batches, "tokens"):
            nodes, labels, ns = (np.asarray(batch.column(c), np.int64) for c in ("node", "label", "n"))
            found = [prefix(np.frombuffer(t, np.uint64), levels) for t in batch.column("tokens").to_pylist()]
            counts = [len(f) for f in found]
            token = np.concatenate(found)
            place = np.concatenate([np.arange(c, dtype=np.int64) for c in counts])
            node, label, n = (np.repeat(x, counts) for x in (nodes, labels, ns))
            bucket = (token % np.uint64(self.buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
            rows = []
            for b in np.flatnonzero(np.diff(cuts)):
                own = order[cuts[b] : cuts[b + 1]]
                rows.append((int(b), token[own].tobytes(), place[own].astype(np.uint32).tobytes(), n[own].astype(np.uint32).tobytes(), node[own].tobytes(), label[own].tobytes()))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], ["bucket", "tokens", "places", "ns", "nodes", "labels"])


_POSTING = "bucket int, tokens binary, places binary, ns binary, nodes binary, labels binary"


def _lists(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, ...] | None:
    """The bucket's lists of two entries or more, sorted by token, n and node; and where lists start."""
    kinds = {"tokens": np.uint64, "places": np.uint32, "ns": np.uint32, "nodes": np.int64, "labels": np.int64}
    blocks = [row for batch in batches for row in zip(*[batch.column(c).to_pylist() for c in kinds], strict=True)]
    if not blocks:
        return None
    token, place, n, node, label = (np.concatenate([np.frombuffer(b[i], t) for b in blocks]) for i, t in enumerate(kinds.values()))
    order = np.argsort(token)
    same = token[order[1:]] == token[order[:-1]]
    order = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
    if not len(order):
        return None
    order = order[np.lexsort((node[order], n[order], token[order]))]
    token = token[order]
    starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    return place[order].astype(np.int64), n[order].astype(np.int64), node[order], label[order], np.append(starts, len(token))


def _admitted(n: np.ndarray, m: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Size and place filters: n, m sizes, i, j places of the shared shingle in the order."""
    return (PERCENT * np.maximum(n, m) <= 100 * np.minimum(n, m)) & (1 + np.minimum(n - 1 - i, m - 1 - j) >= overlap_needed(n, m))


def _hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, votes): nodes of a list with their hub there, where the labels differ.  The hub is the
    node with the fewest rarer shingles of its own, so of near copies the text they come from; nodes
    that the filters keep from it get a hub among themselves."""
    found = _lists(batches)
    if found is None:
        return
    place, n, node, label, starts = found
    lefts, rights = [], []
    for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if (label[lo:hi] == label[lo]).all():
            continue
        rest = np.arange(lo, hi)
        while len(rest) > 1:
            hub = rest[place[rest].argmin()]
            ok = _admitted(n[rest], n[hub], place[rest], place[hub]) & (rest != hub)
            other = rest[ok & (label[rest] != label[hub])]
            lefts.append(node[other])
            rights.append(np.full(len(other), node[hub]))
            rest = rest[~ok & (rest != hub)]
    if not lefts:
        return
    pairs, votes = np.unique(np.stack([np.concatenate(lefts), np.concatenate(rights)]), axis=1, return_counts=True)
    for i in range(0, len(votes), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0, i : i + 50_000]), pa.array(pairs[1, i : i + 50_000]), pa.array(votes[i : i + 50_000].astype(np.int64))], ["a", "b", "votes"])


def _enumerated(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...] | None = None) -> Iterator[np.ndarray]:
    """Admitted pairs of entries (place, n, node, label) with different labels, of one block (sorted by
    n) or of two of which the first has the smaller n; some at a time, as arrays of two rows."""
    place, n, node, label = left
    others = left if right is None else right
    held, size = [], 0
    stops = np.searchsorted(others[1], 100 * n // PERCENT, "right")
    for k in range(len(n)):
        own = slice(k + 1 if right is None else 0, int(stops[k]))
        ok = _admitted(others[1][own], n[k], others[0][own], place[k]) & (others[3][own] != label[k])
        if ok.any():
            other = others[2][own][ok]
            held.append(np.stack([np.minimum(other, node[k]), np.maximum(other, node[k])]))
            size += len(other)
        if size > 500_000:
            yield np.unique(np.concatenate(held, axis=1), axis=1)
            held, size = [], 0
    if held:
        yield np.unique(np.concatenate(held, axis=1), axis=1)


_ACROSS = "a long, b long, p binary, q binary"


def _pair_rows(pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, pairs.shape[1], 50_000):
        a, b = pairs[:, i : i + 50_000]
        none = pa.nulls(len(a), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none, none], ["a", "b", "p", "q"])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): admitted pairs of one list with different labels; of a long list (p, q): two of its
    blocks that can hold such pairs, q empty for one block with itself."""
    found = _lists(batches)
    if found is None:
        return
    *columns, starts = found
    n, label = columns[1], columns[3]
    small: list[np.ndarray] = []
    size = 0
    for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if (label[lo:hi] == label[lo]).all():
            continue
        if hi - lo <= LONG:
            for pairs in _enumerated(tuple(c[lo:hi] for c in columns)):
                small.append(pairs)
                size += pairs.shape[1]
                if size > 500_000:
                    yield from _pair_rows(np.unique(np.concatenate(small, axis=1), axis=1))
                    small, size = [], 0
            continue
        cuts = [slice(i, min(i + LIST_BLOCK, hi)) for i in range(lo, hi, LIST_BLOCK)]
        for x, p in enumerate(cuts):
            packed = [(np.stack([c[p] for c in columns]).tobytes(), b"")] if (label[p] != label[lo]).any() or x == 0 else []
            for q in cuts[x + 1 :]:
                if PERCENT * n[q][0] > 100 * n[p][-1]:
                    break
                if (label[q] != label[p][0]).any() or (label[p] != label[p][0]).any():
                    packed.append((np.stack([c[p] for c in columns]).tobytes(), np.stack([c[q] for c in columns]).tobytes()))
            for i in range(0, len(packed), 50):
                some = packed[i : i + 50]
                none = pa.nulls(len(some), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, *[pa.array(c, pa.binary()) for c in zip(*some, strict=True)]], ["a", "b", "p", "q"])
    if small:
        yield from _pair_rows(np.unique(np.concatenate(small, axis=1), axis=1))


def _blocks_met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of two blocks of a long list."""
    for batch in batches:
        for p, q in zip(batch.column("p").to_pylist(), batch.column("q").to_pylist(), strict=True):
            left, right = (tuple(np.frombuffer(x, np.int64).reshape(4, -1)) for x in (p, q))
            for pairs in _enumerated(left, right if q else None):
                yield from _pair_rows(pairs)


def across(lists: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of all lists."""
    found = stored(lists.mapInArrow(freed(_across), _ACROSS), "across")
    long = found.where("p is not null").select("p", "q").repartition(partitions(lists.sparkSession)).mapInArrow(freed(_blocks_met), _ACROSS)
    return stored(found.where("p is null").unionByName(long).select("a", "b").distinct(), "pairs")


# --- 3. verification


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link.  Only sets of theirs are shuffled, where the list of these is small."""
    ends = stored(pairs.select(F.explode(F.array("a", "b")).alias("kd")).distinct(), "ends")
    sets = sets.join(bounded_broadcast(ends, 1_000_000), "kd", "left_semi")
    side = lambda k, t: sets.select(F.col("kd").alias(k), F.col("tokens").alias(t))
    left = joined_by(pairs, side("b", "tb"), ["b"], ["a"], "hubs")
    return left.join(side("a", "ta"), "a").mapInArrow(freed(_linked), "a long, b long")


def _group_ids(levels) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = levels.value
        for batch in chunks(batches, "tokens"):
            ids = []
            for n, t in zip(batch.column("n").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                ids.append(xxhash.xxh128_digest(prefix(np.frombuffer(t, np.uint64), table).tobytes() + n.to_bytes(8)))
            yield pa.RecordBatch.from_arrays([batch.column("kd"), batch.column("n"), pa.array(ids, pa.binary())], ["kd", "n", "gid"])

    return run


def _edges(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))


def _labelled(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """What ``Postings`` takes; a set without links is its own component."""
    both = sets.join(labels.withColumnRenamed("u", "kd"), "kd", "left")
    return both.select(F.col("kd").alias("node"), F.coalesce("label", "kd").alias("label"), "n", "tokens")


def links(sets: DataFrame) -> DataFrame:
    """(kd, label) of the components of linked documents of ``sets`` that hold tokens."""
    spark = sets.sparkSession
    live = stored(sets.where(F.col("tokens").isNotNull()), "live")
    levels = spark.sparkContext.broadcast(rarity(live))
    postings = live.agg(F.sum(F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1)).first()[0]
    n = buckets_for(spark, int(postings or 0), BUCKET_POSTINGS)
    lists_of = lambda entries: entries.mapInArrow(freed(Postings(n, levels)), _POSTING).repartitionById(n, "bucket")
    groups = stored(live.select("kd", "n", "tokens").mapInArrow(freed(_group_ids(levels)), "kd long, n long, gid binary"), "groups")
    first = stored(groups.groupBy("gid").agg(F.min("kd").alias("first")), "first")
    inside = joined_by(groups.select("kd", "gid"), first, ["gid"], ["kd"], "inside").where(F.col("kd") != F.col("first")).select(F.col("kd").alias("a"), F.col("first").alias("b"))
    inside = stored(inside, "tried")
    one = stored(verified(inside, live), "links")
    heads = live.join(first.select(F.col("first").alias("kd")), "kd", "left_semi").select("kd", "n", "tokens")
    tried, labels = inside, components(_edges(one))
    least = live.count() // 50
    while True:  # until hubs bring links for few sets only: what they leave, the last pass finds
        votes = lists_of(_labelled(heads, labels)).mapInArrow(freed(_hubs), "a long, b long, votes long").groupBy("a", "b").agg(F.sum("votes").alias("votes")).join(tried, ["a", "b"], "left_anti")
        best = votes.groupBy("a").agg(F.max(F.struct("votes", "b")).alias("x")).select("a", F.col("x.b").alias("b"))
        best = stored(best, "tried")
        new = stored(verified(best, live), "links")
        tried = tried.unionByName(best)
        found = new.count()
        labels = joined(labels, _edges(new)) if found else labels
        if found <= least:
            break
    members = groups.join(labels.withColumnRenamed("u", "kd"), "kd", "left").select("kd", "gid", F.coalesce("label", "kd").alias("label"))
    members = stored(members, "members")
    entries = stored(members.groupBy("gid", "label").agg(F.min("kd").alias("head"), F.count("*").alias("size")), "entries")
    heads = live.select("kd", "n", "tokens").join(entries.select(F.col("head").alias("kd"), "label"), "kd")
    pairs = across(lists_of(heads.select(F.col("kd").alias("node"), "label", "n", "tokens")))
    labels = _with_links(labels, verified(pairs, live))
    apart = _apart(pairs, entries, labels)
    if apart.limit(1).count():
        labels = _with_links(labels, verified(_expanded(apart, entries, members), live))
    return labels.select(F.col("u").alias("kd"), "label")


def _with_links(labels: DataFrame, found: DataFrame) -> DataFrame:
    found = stored(found, "links")
    return joined(labels, _edges(found)) if found.limit(1).count() else labels


def _apart(pairs: DataFrame, entries: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs of entries (a, b) whose heads are still in different components and which have more
    members than these."""
    size = stored(entries.where("size > 1").select("head"), "large")
    label = labels.select(F.col("u").alias("head"), "label")
    now = pairs
    for k in ("a", "b"):
        side = label.select(F.col("head").alias(k), F.col("label").alias(f"l{k}"))
        more = size.select(F.col("head").alias(k), F.lit(True).alias(f"m{k}"))
        now = now.join(side, k, "left").join(more, k, "left").withColumn(f"l{k}", F.coalesce(f"l{k}", k))
    return stored(now.where("la <> lb and (ma or mb)").select("a", "b"), "apart")


def _expanded(apart: DataFrame, entries: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs (a, b) of a member of the one entry and a member of the other."""
    wanted = apart.select(F.explode(F.array("a", "b")).alias("head")).distinct()
    some = entries.join(wanted, "head", "left_semi").select("gid", "label", "head")
    held = stored(joined_by(members, some, ["gid", "label"], ["kd"], "held").select("head", "kd"), "held")
    both = apart
    for k in ("a", "b"):
        both = both.join(held.select(F.col("head").alias(k), F.col("kd").alias(f"k{k}")), k)
    both = both.where("ka <> a or kb <> b").select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"))
    return stored(both.distinct(), "expanded")


# --- 4. numbers of links


#: Distinct sets in a block and shingles of all of these, about; a component with no more is one block.
BLOCK_SETS, BLOCK_SHINGLES = 500, 1_000_000
#: Cells of a dense matrix of sets and shingles.
_DENSE = 4_000_000


def _class_starts() -> np.ndarray:
    """Least size of each size class: linked sets are in one class or in neighbouring ones."""
    starts = [1]
    while starts[-1] < 1 << 40:
        starts.append(100 * starts[-1] // PERCENT + 1)
    return np.array(starts, np.int64)


def _set_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    starts = _class_starts()
    for batch in chunks(batches, "tokens"):
        ids = [xxhash.xxh128_digest(t) for t in batch.column("tokens").to_pylist()]
        size = np.searchsorted(starts, np.asarray(batch.column("n")), "right").astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("kd"), batch.column("label"), batch.column("n"), pa.array(size), pa.array(ids, pa.binary())], ["kd", "label", "n", "size", "sid"])


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each two sets."""
    m = len(sets)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    token = np.concatenate(sets)
    order = np.argsort(token, kind="stable")
    row, token = row[order], token[order]
    cell = np.cumsum(np.concatenate([[True], token[1:] != token[:-1]])) - 1
    times = np.bincount(cell)
    often = times > max(8, m // 16)
    both, low = np.zeros((m, m)), np.zeros((m, m))
    place = np.cumsum(often) - 1
    own = often[cell]
    r, c = row[own], place[cell[own]]
    width = _DENSE // m + 1
    for i in range(0, int(often.sum()), width):
        lo, hi = np.searchsorted(c, [i, i + width])
        x = np.zeros((m, width), np.float32)
        x[r[lo:hi], c[lo:hi] - i] = 1
        both += x @ x.T
    own = ~own & (times[cell] > 1)
    r, c = row[own], cell[own]
    for d in range(1, max(8, m // 16)):
        same = c[d:] == c[:-d]
        if not same.any():
            break
        np.add.at(low.ravel(), (r[:-d] * m + r[d:])[same], 1)
    return both + low + low.T


def _linked_docs(rows: list[tuple]) -> np.ndarray:
    """For each (kd, docs, side, tokens) of two blocks the documents of sets of the other block (of a
    single block: other sets of it) that link."""
    sets = [np.frombuffer(t, np.uint64) for *_, t in rows]
    docs, side = (np.array([r[i] for r in rows], np.int64) for i in (1, 2))
    n = np.array([len(s) for s in sets])
    both = overlaps(sets)
    linked = 100 * both >= PERCENT * (n[:, None] + n - both)
    if (side < 0).all():
        np.fill_diagonal(linked, False)
    else:
        linked &= side[:, None] != side
    return linked @ docs


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kd, linked) of rows that are sorted by their pair of blocks."""

    def flush() -> None:
        if len(held) > 1:
            kds.extend(r[0] for r in held)
            found.append(_linked_docs(held))

    key, held, kds, found = None, [], [], []
    for batch in batches:
        for *now, kd, docs, side, tokens in zip(*[batch.column(c).to_pylist() for c in ("label", "low", "p", "q", "kd", "docs", "side", "tokens")], strict=True):
            if now != key:
                flush()
                key, held = now, []
            held.append((kd, docs, side, tokens))
        if kds:
            yield pa.RecordBatch.from_arrays([pa.array(kds, pa.int64()), pa.array(np.concatenate(found))], ["kd", "linked"])
            kds, found = [], []
    flush()
    if kds:
        yield pa.RecordBatch.from_arrays([pa.array(kds, pa.int64()), pa.array(np.concatenate(found))], ["kd", "linked"])


#: The pairs of blocks in which a set of block b meets others; side -1: those of its own block.
#: Within a size class p <= q, across classes q is negative: -1 - block of the larger class.
_MEETS = """CASE WHEN blocks IS NULL THEN array(named_struct('low', -1, 'p', 0, 'q', 0, 'side', -1)) ELSE concat(
transform(sequence(0, blocks - 1), x -> named_struct('low', size, 'p', least(b, x), 'q', greatest(b, x), 'side', CASE WHEN b = x THEN -1 WHEN b < x THEN 0 ELSE 1 END)),
transform(filter(sequence(0, above), x -> x < above), x -> named_struct('low', size, 'p', b, 'q', -1 - x, 'side', 0)),
transform(filter(sequence(0, below), x -> x < below), x -> named_struct('low', size - 1, 'p', x, 'q', -1 - b, 'side', 1))) END"""


def numbers_of_links(sets: DataFrame, labels: DataFrame, held: DataFrame) -> DataFrame:
    """(kd, n_links) of each text with a label: the other documents that link with a document of it.
    ``held`` has the number of documents (kd, docs) of each text."""
    n = partitions(sets.sparkSession)
    live = sets.where(F.col("tokens").isNotNull()).select("kd", "n", "tokens")
    ids = live.join(labels, "kd").mapInArrow(freed(_set_ids), "kd long, label long, n long, size int, sid binary")
    ids = stored(ids.join(held, "kd"), "ids")
    alike = ids.groupBy("label", "sid", "n", "size").agg(F.min("kd").alias("head"), F.sum("docs").alias("docs"))
    alike = stored(alike, "alike")
    sizes = alike.groupBy("label", "size").agg(F.count("*").alias("m"), F.sum("n").alias("t"))
    own, near = Window.partitionBy("label"), Window.partitionBy("label").orderBy("size")
    large = (F.sum("m").over(own) > BLOCK_SETS) | (F.sum("t").over(own) > BLOCK_SHINGLES)
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK_SETS, F.col("t") / BLOCK_SHINGLES)).cast("int")
    large = sizes.select("label", "size", blocks.alias("blocks"), large.alias("large")).where("large")
    at = lambda i: F.coalesce(F.sum("blocks").over(near.rangeBetween(i, i)), F.lit(0)).cast("int")
    large = stored(large.select("label", "size", "blocks", at(1).alias("above"), at(-1).alias("below")), "large")
    dealt = alike.join(bounded_broadcast(large, 1_000_000), ["label", "size"], "left").withColumn("b", F.pmod(F.xxhash64("head"), F.col("blocks")).cast("int"))
    dealt = dealt.select(F.col("head").alias("kd"), "label", "docs", F.expr(_MEETS).alias("meets"))
    dealt = live.select("kd", "tokens").join(dealt, "kd").select("kd", "label", "docs", F.explode("meets").alias("m"), "tokens")
    dealt = dealt.select("label", "m.low", "m.p", "m.q", "kd", "docs", "m.side", "tokens")
    pair = ["label", "low", "p", "q"]
    met = dealt.repartition(n, *pair).sortWithinPartitions(*pair).mapInArrow(freed(_met), "kd long, linked long")
    linked = met.groupBy(F.col("kd").alias("head")).agg(F.sum("linked").alias("linked"))
    each = alike.join(linked, "head", "left").select("label", "sid", (F.col("docs") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    return ids.select("kd", "label", "sid").join(each, ["label", "sid"]).select("kd", "n_links")


def _classed(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``classes``, and ``rows``, ``sets`` and labels it is made of."""
    rows = stored(contents(docs), "contents")
    sets = sets_of(docs, rows)
    labels = links(sets)
    nodes = sets.select("kd", "k1", "k2", "n").join(labels, "kd", "left")
    nodes = stored(nodes.select("kd", "k1", "k2", "n", F.coalesce("label", "kd").alias("label")), "nodes")
    least = nodes.groupBy("label").agg(F.min(F.struct("k1", "k2", "kd")).alias("first"))
    nodes = nodes.join(least, "label").select(F.col("kd").alias("rep"), "n", F.col("first.k1").alias("c1"), F.col("first.kd").alias("ckd"))
    reps = rows.groupBy("content").agg(F.min(F.struct("k1", "k2", "kd")).alias("x")).select("content", F.col("x.kd").alias("rep"))
    reps = stored(reps.join(nodes, "rep"), "reps")
    out = joined_by(rows.drop("bytes"), reps, ["content"], ["kd"], "classes")
    empty = F.col("n") == 0
    least_id = F.when(F.col("c1") != NULL_ID, F.col("c1"))
    out = out.select("doc_id", "kd", F.col("n").alias("n_shingles"), F.when(empty, F.col("doc_id")).otherwise(least_id).alias("component_id"), F.when(empty, F.col("kd")).otherwise(F.col("ckd")).alias("component_kd"), "rep")
    return out, rows, sets, labels


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, kd, n_shingles, component_id, component_kd) of each row: component_kd is the key of
    the class's first document."""
    return _classed(docs)[0].drop("rep")


def counted(docs: DataFrame) -> DataFrame:
    """``classes`` with n_links: the other documents that link with the row's document."""
    out, rows, sets, labels = _classed(docs)
    held = rows.groupBy("content").agg(F.min(F.struct("k1", "k2", "kd")).alias("x"), F.count_distinct("kd").alias("docs"))
    held = stored(held.select(F.col("x.kd").alias("kd"), "docs"), "held")
    found = held.join(numbers_of_links(sets, labels, held), "kd", "left")
    found = stored(found.select(F.col("kd").alias("rep"), F.coalesce("n_links", F.col("docs") - 1).alias("n_links")).where("n_links > 0"), "found")
    n_links = F.when(F.col("n_shingles") > 0, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long")
    return out.join(found, "rep", "left").drop("rep").withColumn("n_links", n_links)


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = counted(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id", "n_links")


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: the first document of each class, once."""
    names = docs.columns
    found = stored(classes(docs), "classes")
    stay = found.where(F.col("kd") == F.col("component_kd")).groupBy("kd").agg(F.count("*").alias("times"))
    stay = bounded_broadcast(stored(stay, "stay"), 1_000_000)
    k1 = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    kd = F.xxhash64(k1, F.xxhash64(F.coalesce("text", F.lit(""))))
    row = docs.select(kd.alias("kd"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")).join(stay, "kd")
    once = row.where(F.col("times") == 1).select("row.*")
    if not stay.where(F.col("times") > 1).limit(1).count():
        return once
    return once.unionByName(row.where(F.col("times") > 1).dropDuplicates(["kd"]).select("row.*"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each class stays."""
    return first_of_each(docs)
