"""Substring deduplication by automata over repeated phrases.

A word goes if one of the ``WINDOW``-word windows that cover it also starts earlier: in a document
with a smaller id, or earlier in the same document.  Windows are judged on the input.

1. Anchors.  Of the ``GRAM``-word runs in a window the one with the least hash is its anchor, so
   equal windows have equal anchors at equal places, and a document has one anchor for about seven
   words.  Anchor hashes are dealt to buckets; a bucket keeps those found at two places or more.
2. Confirmation.  Documents meet their recurring anchors and send the text around each, as far as
   its windows reach, to a shard chosen by the anchor's words.  A shard numbers the words and counts
   the windows by a hash of their numbers: those found twice are candidates.
3. Automata.  Each shard compiles its candidates' word sequences into Aho-Corasick automata (a new one
   for each ``SHARD`` texts, so memory is bounded) and streams the texts through them.  The automata
   locate every occurrence: the first of each passage stays, every other is a removed window.

Only the text around recurring anchors is streamed: no other place can hold a window that recurs, as
equal windows have equal anchors.  The number of shards grows with the measured bytes of these texts
and the number of anchor buckets with the input, so that a task's share doesn't.

No anchor's places meet in one task.  One that a task finds ``OFTEN`` times or more among the anchors that
it gathers recurs for certain: the task hands these places on at once, as pieces of at most about ``HOT``, and the
anchor's bucket only learns that there are such.  A bucket does the same with what it holds when it has
grown beyond its share.  The other places of such an anchor, and those of one at more than ``HOT`` places,
are dealt over several shards by document too.  A shard reports the first occurrence of each window of
dealt places as well, and a last step, in tasks by the measured number of such places, keeps only the
earliest of these: how places are dealt doesn't change the result.  Copies of a whole text are not searched: each window of a copy also starts in the
one with the least id, so all but that one lose every word that a window covers.

Nulls: a null text has no words; rows without an id come after all others.  Rows with the same id
and text are one document given several times: each gets its result.  Rows with the same id and
different texts are ordered by a hash of the text, so there are no ties.  A very long text is one
task's, in memory in proportion to its words.  Extra columns stay as they are, whatever their names.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglathe.llm.common import NULL_ID, buckets_for, chunks, doc_key, freed, joined_by, read_table, small_batches, stored, utf8, window_hashes, word_hashes

WINDOW, GRAM = 20, 8
_REACH = WINDOW - GRAM + 1  # anchors to choose from in a window
HOT, OFTEN = 4096, 64
SHARD = 8_000
#: Shape of an entry that stands for places handed on elsewhere.
_ELSEWHERE = 255
#: Anchors in a bucket and bytes of text in a shard, about.
BUCKET_ANCHORS, SHARD_BYTES = 4_000_000, 64 << 20
#: Windows of dealt anchors in a task of the last step, about.
TASK_WINDOWS = 1_000_000
#: Anchors that a task gathers before it hands them on.
_FLUSH = 500_000


def anchors(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of windows with one anchor: the anchor's hash and place, the first window's
    start and the number of windows."""
    if len(words) < WINDOW:
        return (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)
    grams = window_hashes(word_hashes(words), GRAM)
    n = len(words) - WINDOW + 1
    place = np.arange(n) + sliding_window_view(grams, _REACH).argmin(1)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    at = place[first]
    return grams[at], at, first, np.diff(np.append(first, n))


def _base(docs: DataFrame) -> DataFrame:
    """kd, k1, k2, text and a struct of the other columns.  Every use selects all of these, so the
    one exchange by ``kd`` serves all of them."""
    k1 = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    k2 = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    null = F.col("text").isNull().alias("no_text")
    return docs.select(F.xxhash64(k1, k2).alias("kd"), k1.alias("k1"), k2.alias("k2"), utf8("text").alias("text"), null, row.alias("row"))


def _copies(docs: DataFrame) -> tuple[DataFrame, int]:
    """(kd, k1, k2) of the documents whose whole text has a smaller id elsewhere, and all texts' bytes."""
    keyed = doc_key(docs).select(F.xxhash64("k1", "k2").alias("kd"), "k1", "k2", F.unhex(F.sha2("text", 256)).alias("content"), F.octet_length("text").alias("bytes"))
    keyed = stored(keyed, "contents")
    first = keyed.groupBy("content").agg(F.min("k1").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = joined_by(keyed.drop("bytes"), first, ["content"], ["kd"], "copies").where(F.col("k1") > F.col("first"))
    return later.groupBy("kd", "k1", "k2").agg(F.count("*").alias("rows")).drop("rows"), keyed.agg(F.sum("bytes")).first()[0] or 0


_BLOCK = "bucket int, kds binary, counts binary, hashes binary, starts binary, shapes binary, pieces binary"
_RECURRING = "kd long, starts binary, shapes binary, pieces binary, dealt int"


def _pieces(kd: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The piece of each place of dealt anchors with so many places: 1 or more."""
    return (1 + kd % -(-sizes // HOT)).astype(np.uint32)


def _by_document(kd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of rows of one document starts, and the runs' lengths."""
    new = np.flatnonzero(np.concatenate([[True], kd[1:] != kd[:-1]]))
    return new, np.diff(np.append(new, len(kd)))


def _find_anchors(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            kd = np.repeat(np.array([h[0] for h in held], np.int64), [len(h[1]) for h in held])
            hashes, starts, shapes = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
            rows = []
            anchor, group, counts = np.unique(hashes, return_inverse=True, return_counts=True)
            often = counts >= OFTEN
            if often.any():
                now = often[group]
                pieces = np.maximum(_pieces(kd[now], counts[group[now]]) + np.uint32(kd[0] & 0xFFFFFFFF), 1).astype(np.uint32)
                new, runs = _by_document(kd[now])
                rows.append((int(kd[0] % buckets), kd[now][new].tobytes(), runs.astype(np.uint32).tobytes(), b"", starts[now].tobytes(), shapes[now].tobytes(), pieces.tobytes()))
                told = anchor[often]
                kd, hashes, starts, shapes = kd[~now], np.concatenate([hashes[~now], told]), starts[~now], shapes[~now]
                kd, starts = (np.concatenate([x, np.zeros(len(told), x.dtype)]) for x in (kd, starts))
                shapes = np.concatenate([shapes, np.full(len(told), _ELSEWHERE, np.uint8)])
            bucket = (hashes % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cuts)):
                own = order[cuts[b] : cuts[b + 1]]
                of = kd[own]
                new, runs = _by_document(of)
                rows.append((int(b), of[new].tobytes(), runs.astype(np.uint32).tobytes(), hashes[own].tobytes(), starts[own].tobytes(), shapes[own].tobytes(), b""))
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], [x.split()[0] for x in _BLOCK.split(", ")])

        for batch in chunks(batches):
            for kd, copy, text in zip(batch.column("kd").to_pylist(), batch.column("copies").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if copy:
                    continue
                hashes, place, first, windows = anchors(text.split())
                if len(hashes):
                    held.append((kd, hashes, first.astype(np.uint32), ((place - first) << 4 | (windows - 1)).astype(np.uint8)))
                    size += len(hashes)
            if size >= _FLUSH:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return run


def _handed_on(kd: np.ndarray, starts: np.ndarray, shapes: np.ndarray, pieces: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Recurring anchors' places as a row for each document."""
    if not len(kd):
        return
    order = np.argsort(kd, kind="stable")
    kd, starts, shapes, pieces = kd[order], starts[order], shapes[order], pieces[order]
    new, runs = _by_document(kd)
    dealt = np.add.reduceat((pieces > 0).astype(np.int32), new)
    for i in range(0, len(new), 10_000):
        cut = [slice(a, a + n) for a, n in zip(new[i : i + 10_000].tolist(), runs[i : i + 10_000].tolist(), strict=True)]
        columns = [pa.array(kd[new[i : i + 10_000]], pa.int64())]
        columns += [pa.array([values[c].tobytes() for c in cut], pa.binary()) for values in (starts, shapes, pieces)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(dealt[i : i + 10_000], pa.int32())], [x.split()[0] for x in _RECURRING.split(", ")])


_Held = list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def _reduced(held: _Held) -> tuple[_Held, Iterator[pa.RecordBatch]]:
    """What a bucket must keep of its anchors, and the places of frequent ones, which needn't wait."""
    kd, hashes, starts, shapes = (np.concatenate(x) for x in zip(*held, strict=True))
    anchor, group, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    often = counts >= OFTEN
    often[group[shapes == _ELSEWHERE]] = True
    now, told = often[group], anchor[often]
    out = now & (shapes != _ELSEWHERE)
    ready = _handed_on(kd[out], starts[out], shapes[out], _pieces(kd[out], counts[group[out]]))
    stand = np.zeros(len(told), np.int64), told, np.zeros(len(told), np.uint32), np.full(len(told), _ELSEWHERE, np.uint8)
    return [(kd[~now], hashes[~now], starts[~now], shapes[~now]), stand], ready


def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of one bucket that are at two places or more, by document, with the piece of each place:
    0 if its anchor isn't dealt.  Places handed on already pass through."""
    held: _Held = []
    size, room = 0, 2 * BUCKET_ANCHORS
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("kds", "counts", "hashes", "starts", "shapes", "pieces")], strict=True):
            kds, counts, hashes, starts, shapes, pieces = (np.frombuffer(x, t) for x, t in zip(row, (np.int64, np.uint32, np.uint64, np.uint32, np.uint8, np.uint32), strict=True))
            kd = np.repeat(kds, counts)
            if len(pieces):
                yield from _handed_on(kd, starts, shapes, pieces)
                continue
            held.append((kd, hashes, starts, shapes))
            size += len(kd)
            if size >= room:
                held, ready = _reduced(held)
                yield from ready
                size = sum(len(x) for x, *_ in held)
                room = max(room, 2 * size)
    if not held:
        return
    kd, hashes, starts, shapes = (np.concatenate(x) for x in zip(*held, strict=True))
    held.clear()
    order = np.argsort(hashes)
    sorted_hashes = hashes[order]
    same = sorted_hashes[1:] == sorted_hashes[:-1]
    order = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
    order = order[np.lexsort((shapes[order], starts[order], kd[order], hashes[order]))]
    if not len(order):
        return
    new = np.arange(len(order)) == 0
    for values in (kd, starts, hashes, shapes):
        new[1:] |= values[order[1:]] != values[order[:-1]]
    order = order[new]  # without rows given twice
    group = np.concatenate([[0], np.cumsum(hashes[order[1:]] != hashes[order[:-1]])])
    place = shapes[order] != _ELSEWHERE
    size = np.bincount(group, place).astype(np.int64)[group]
    dealt = (np.bincount(group, ~place)[group] > 0) | (size > HOT)
    chosen = place & (dealt | (size > 1))
    order, size, dealt = order[chosen], size[chosen], dealt[chosen]
    yield from _handed_on(kd[order], starts[order], shapes[order], np.where(dealt, _pieces(kd[order], size), 0).astype(np.uint32))


_TEXTS = "shard int, keys binary, k1s binary, k2s binary, starts binary, windows binary, sizes binary, hot binary, texts binary"


def _send_texts(shards: int):
    """The words around each recurring anchor, to the anchor's shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            out: dict[int, list] = {}
            for kd, k1, k2, text, found in zip(*[batch.column(c).to_pylist() for c in ("kd", "k1", "k2", "text", "found")], strict=True):
                if not found:
                    continue
                words = text.split()
                for part in found:
                    starts, shapes, pieces = (np.frombuffer(part[c], t).tolist() for c, t in (("starts", np.uint32), ("shapes", np.uint8), ("pieces", np.uint32)))
                    for start, shape, piece in zip(starts, shapes, pieces, strict=True):
                        place, windows = start + (shape >> 4), (shape & 15) + 1
                        if start + windows + WINDOW - 1 > len(words):
                            continue  # of another document with the same kd
                        key = xxhash.xxh64_intdigest(b" ".join(words[place : place + GRAM]))
                        if piece:
                            key = xxhash.xxh64_intdigest(b"%d %d" % (key, piece))
                        to = out.get(key % shards)
                        if to is None:
                            to = out[key % shards] = [[], [], [], [], [], [], []]
                        for values, v in zip(to, (key >> 32, k1, k2, start, windows, piece > 0, b" ".join(words[start : start + windows + WINDOW - 1])), strict=True):
                            values.append(v)
            if not out:
                continue
            rows = [
                (shard, *[np.array(v, t).tobytes() for v, t in zip(to[:5], (np.uint32, np.int64, np.int64, np.uint32, np.uint8), strict=True)], np.array(list(map(len, to[6])), np.uint32).tobytes(), np.array(to[5], np.uint8).tobytes(), b"".join(to[6]))
                for shard, to in out.items()
            ]
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], [x.split()[0] for x in _TEXTS.split(", ")])

    return run


def recurring_windows(ids: list[int], starts: list[int], windows: list[int]) -> set[tuple[int, ...]]:
    """The word numbers of each window that is found at two places or more, and perhaps of a few others
    that share a window's hash: the automaton finds those once only.  ``ids`` has all texts' words;
    ``starts`` and ``windows`` tell where texts start and how many windows they have."""
    hashes = window_hashes(np.array(ids, np.uint64) + np.uint64(1), WINDOW)
    n = np.array(windows)
    at = np.arange(n.sum()) + np.repeat(np.array(starts) - (np.cumsum(n) - n), n)
    order = np.argsort(hashes[at], kind="stable")
    h, at = hashes[at][order], at[order]
    same = h[1:] == h[:-1]
    again = at[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    return {tuple(ids[a : a + WINDOW]) for a in again.tolist()}


def search(texts: list[tuple[tuple[int, int, int], int, list[bytes]]], every: bool = False) -> tuple[list[tuple[int, int, int]], dict]:
    """One automaton's work.  ``texts``: place of the first word (k1, k2, start), number of windows,
    words.  Gives the places of removed windows, and if ``every`` each window's first place."""
    numbers: dict[bytes, int] = {}
    number = numbers.setdefault
    ids = [number(w, len(numbers)) for *_, words in texts for w in words]
    ends = np.cumsum([len(words) for *_, words in texts]).tolist()
    starts = [0, *ends[:-1]]
    counts = [windows for _, windows, _ in texts]
    if every:
        found = {tuple(ids[a + i : a + i + WINDOW]) for a, n in zip(starts, counts, strict=True) for i in range(n)}
    else:
        found = recurring_windows(ids, starts, counts)
    if not found:
        return [], {}
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    windows = list(found)
    for i, window in enumerate(windows):
        automaton.add_word(window, i)
    automaton.make_automaton()
    first: list[tuple[int, int, int] | None] = [None] * len(windows)
    removed = []
    for ((k1, k2, start), _, _), a, b in zip(texts, starts, ends, strict=True):
        for end, i in automaton.iter(tuple(ids[a:b])):
            place, other = (k1, k2, start + end - WINDOW + 1), first[i]
            if other is None:
                first[i] = place
            elif place != other:  # the same place can be sent for two anchors
                removed.append(max(place, other))
                first[i] = min(place, other)
    names = list(numbers)
    return removed, {window: (place, names) for window, place in zip(windows, first, strict=True)} if every else {}


_FOUND = "route long, k1 long, k2 long, starts binary, windows binary"


def _search_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows for removed windows of a document (route: its kd's part), and for first places of
    windows of hot anchors (route: of the window's hash; ``windows`` is the hash)."""
    kinds = {"keys": np.uint32, "k1s": np.int64, "k2s": np.int64, "starts": np.uint32, "windows": np.uint8, "sizes": np.uint32, "hot": np.uint8}
    blocks = [row for batch in batches for row in zip(*[batch.column(c).to_pylist() for c in [*kinds, "texts"]], strict=True)]
    if not blocks:
        return
    arrays = {c: np.concatenate([np.frombuffer(b[i], t) for b in blocks]) for i, (c, t) in enumerate(kinds.items())}
    sizes = arrays["sizes"].astype(np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    everything = b"".join(b[7] for b in blocks)
    del blocks
    parts = -(-len(sizes) // SHARD)
    part = arrays["keys"] % parts
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    for p in range(parts):
        own = order[cuts[p] : cuts[p + 1]]
        for hot in (0, 1):
            chosen = own[arrays["hot"][own] == hot].tolist()
            if not chosen:
                continue
            k1s, k2s, starts, windows = (arrays[c] for c in ("k1s", "k2s", "starts", "windows"))
            texts = [((int(k1s[i]), int(k2s[i]), int(starts[i])), int(windows[i]), everything[begins[i] : ends[i]].split()) for i in chosen]
            removed, first = search(texts, every=bool(hot))
            by_doc: dict[tuple[int, int], list[int]] = {}
            for k1, k2, start in removed:
                by_doc.setdefault((k1, k2), []).append(start)
            rows = [(k2, k1, k2, np.array(s, np.uint32).tobytes(), None) for (k1, k2), s in by_doc.items()]
            if hot:
                for window, ((k1, k2, start), names) in first.items():
                    digest = hashlib.blake2b(b" ".join([names[i] for i in window]), digest_size=16).digest()
                    rows.append((int.from_bytes(digest[:8], signed=True), k1, k2, np.array([start], np.uint32).tobytes(), digest))
            for i in range(0, len(rows), 10_000):
                columns = zip(*rows[i : i + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["route", "k1", "k2", "starts", "windows"])


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass removed windows on; of windows of hot anchors all but the earliest are removed too."""
    earliest: dict[bytes, tuple[int, int, int]] = {}
    names = ["k1", "k2", "starts"]
    schema = (pa.int64(), pa.int64(), pa.binary())
    for batch in batches:
        rows = []
        for k1, k2, starts, window in zip(*[batch.column(c).to_pylist() for c in ("k1", "k2", "starts", "windows")], strict=True):
            if window is None:
                rows.append((k1, k2, starts))
                continue
            place = (k1, k2, int(np.frombuffer(starts, np.uint32)[0]))
            other = earliest.setdefault(window, place)
            if other != place:
                earliest[window] = min(place, other)
                late = max(place, other)
                rows.append((late[0], late[1], np.array([late[2]], np.uint32).tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], names)


def removed_mask(n_words: int, starts: np.ndarray) -> np.ndarray:
    edge = np.zeros(n_words + 1, np.int32)
    starts = np.unique(starts)
    edge[starts] += 1
    edge[starts + WINDOW] -= 1
    return np.cumsum(edge[:-1]) > 0


def _kept(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bytes]]:
    """Words, removed words and kept text of each row."""
    for k1, k2, text, found in zip(*[batch.column(c).to_pylist() for c in ("k1", "k2", "text", "found")], strict=True):
        words = text.split()
        n = len(words)
        own = [f for f in found or () if (f["k1"], f["k2"]) == (k1, k2)]
        if n < WINDOW or not own:
            kept = words
        elif any(f["starts"] is None for f in own):
            kept = []
        else:
            mask = removed_mask(n, np.concatenate([np.frombuffer(f["starts"], np.uint32) for f in own]))
            kept = [words[i] for i in np.flatnonzero(~mask).tolist()]
        yield n, n - len(kept), b" ".join(kept)


def found_windows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents by ``kd``, and ``found``: for each ``kd`` the removed windows' starts (null:
    the whole text is a copy)."""
    small_batches(docs.sparkSession)
    base, (copies, size) = _base(docs), _copies(docs)
    by_kd = lambda right: base.join(right.hint("shuffle_hash"), "kd", "left")
    flagged = by_kd(copies.groupBy("kd").agg(F.count("*").alias("copies")))
    # About an anchor for 40 bytes of text.
    buckets = buckets_for(docs.sparkSession, size // 40, BUCKET_ANCHORS)
    recurring = flagged.mapInArrow(freed(_find_anchors(buckets)), _BLOCK).repartitionById(buckets, "bucket").mapInArrow(freed(_recurring), _RECURRING)
    recurring = stored(recurring, "anchors")
    # Four bytes of starts for each anchor, whose text has about 27 words.
    starts, dealt = recurring.agg(F.sum(F.octet_length("starts")), F.sum("dealt")).first()
    shards = buckets_for(docs.sparkSession, (starts or 0) // 4 * 170, SHARD_BYTES)
    places = recurring.groupBy("kd").agg(F.collect_list(F.struct("starts", "shapes", "pieces")).alias("found"))
    searched = by_kd(places).mapInArrow(freed(_send_texts(shards)), _TEXTS).repartitionById(shards, "shard").mapInArrow(freed(_search_shard), _FOUND)
    n = buckets_for(docs.sparkSession, (dealt or 0) * _REACH, TASK_WINDOWS)
    resolved = searched.repartitionById(n, F.pmod(F.col("route"), F.lit(n)).cast("int")).mapInArrow(freed(_resolve), "k1 long, k2 long, starts binary")
    rows = resolved.select(F.xxhash64("k1", "k2").alias("kd"), "k1", "k2", "starts").unionByName(copies.withColumn("starts", F.lit(None).cast("binary")))
    found = rows.groupBy("kd").agg(F.collect_list(F.struct("k1", "k2", "starts")).alias("found"))
    return base, by_kd(found)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with what is left as ``text``; a text from which nothing was removed
    stays as it is.  A column ``n_chars`` is set to the new length."""
    names = docs.columns
    _, judged = found_windows(docs)
    kind = judged.schema["row"].dataType
    schema = T.StructType([T.StructField("row", kind), T.StructField("new_text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts = batch.column("text").to_pylist()
            empty = batch.column("no_text").to_pylist()
            kept = [None if null else (rest if removed else text).decode() for text, null, (_, removed, rest) in zip(texts, empty, _kept(batch), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(kept, pa.string())], ["row", "new_text"])

    out = judged.mapInArrow(freed(run), schema)
    new = {"text": F.col("new_text"), "n_chars": F.length("new_text").cast(docs.schema["n_chars"].dataType) if "n_chars" in names else None}
    return out.select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in names])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every row stays, without its repeated passages."""
    return deduplicated(docs)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            n, removed, rest = zip(*_kept(batch), strict=True)
            ids = batch.column("row").field("doc_id")
            digest = [hashlib.sha256(x).hexdigest() for x in rest]
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    _, judged = found_windows(docs)
    return judged.mapInArrow(freed(run), "doc_id long, n_words long, n_removed long, kept_sha256 string")
