"""Phrase collocations from a weighted de Bruijn graph.

Texts are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words; A-Z is lower-cased.  For each
language, nodes are two words in a row and an edge leads from (u, v) to (v, w) for three words in a row,
weighted with their occurrences.

1. Edges.  A task numbers its words, counts three words in a row and sends each bucket its part, with the
   words' hashes once.  At the end of a piece an edge leads to the end mark, which is the correction that makes flows
   whole: all edges out of a node, marks included, add up to the node's occurrences, and all flow that
   starts with a word to that word's.  So only longest phrases are counted in the texts.
2. Flow.  A bucket holds whole nodes: it adds equal edges, then the flow of each node.  Words' flows are added
   by hash, next to their text.  Only what occurs ``LEAST`` times leaves a bucket; rarer phrases can't
   be part of a candidate.
3. Paths.  Where a node has one edge in and one out, edges are one path.  Pointers to the edge before
   are doubled until they reach a path's first edge; edges on a closed ring stay single.
   Long paths are cut every ``PATH_EDGES`` edges.
4. Candidates come from the paths: each edge is a phrase of three words, and a node inside a path meets
   just the two edges beside it, while those at the ends, or on no path, are judged by all paths that meet there.

A node that would fill a bucket is dealt over several by its third word.  Which nodes these are is
guessed from a sample of documents, of a thousandth of the words or more: it decides where rows go, not
what they count.  Words are told apart by 64-bit hashes; two words with one hash, of which one may be in a candidate,
are found where words are added, and all is counted again with another seed.

Nulls: a null text has no words, a null language is ``und``.  A very long text is one task's, in memory in
proportion to its words.  Repeated rows are counted each.  Ties in score and count go by the phrase's
bytes, so ranks are unique.  Extra columns are not read.  An empty table, or one without a repeated phrase,
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loglathe.llm.common import buckets_for, chunks, freed, read_table, small_batches, stored, utf8

LEAST, INSIDE_PERCENT, TOP = 10, 50, 2000
PATH_EDGES = 1000
#: A language's candidates are ranked in so many parts first.
RANK_PARTS = 64
#: Edges of a bucket and words of the sample, about.
BUCKET_EDGES, SAMPLE_WORDS = 1_500_000, 4_000_000
#: Nodes that can be dealt over several buckets, at most about (their list goes to every task).
MOST_HOT = 1_000_000
#: Words that a task gathers before it hands them on: their ids cubed fit 63 bits.
_FLUSH, _FLUSH_BYTES = 1_900_000, 32 << 20
_END = b"\xff"  # is in no UTF-8 text

_MIX, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _table() -> bytes:
    lower = bytearray(bytes(range(256)).lower())
    for mark in b".,;:!?\n\x0b\x0c\r":
        lower[mark] = _END[0]
    return bytes(lower)


_LOWER = _table()


def tokens(text: bytes) -> list[bytes]:
    """The text's words, with an end mark after each piece."""
    return text.translate(_LOWER).replace(_END, b" \xff ").split() + [_END]


class _Ids(dict):
    """Numbers words from 0 in the order in which they come; the end mark is 0."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def edges_of(ids: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct edges (three ids, 0 from the end of the piece on) and their counts, in order of ids."""
    ids = np.append(ids, [0, 0]).astype(np.int64)
    a, b, c = ids[:-2], ids[1:-1], ids[2:]
    at = a != 0
    a, b, c = a[at], b[at], c[at]
    c = np.where(b == 0, 0, c)
    if n_words < 1 << 21:
        keys, counts = np.unique((a * n_words + b) * n_words + c, return_counts=True)
        keys, c = np.divmod(keys, n_words)
        a, b = np.divmod(keys, n_words)
        return a, b, c, counts
    order = np.lexsort((c, b, a))
    a, b, c = a[order], b[order], c[order]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])])) if len(a) else np.empty(0, np.int64)
    return a[new], b[new], c[new], np.diff(np.append(new, len(a)))


def _node_hashes(w1: np.ndarray, w2: np.ndarray) -> np.ndarray:
    out = (w1 * _MIX + w2) * _TURN
    return out ^ (out >> np.uint64(31))


def _buckets(w1: np.ndarray, w2: np.ndarray, w3: np.ndarray, n_buckets: int, hot: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """The node's bucket; of a hot node one of several, by the third word."""
    nodes = _node_hashes(w1, w2)
    if hot is not None and len(hot[0]):
        at = np.minimum(np.searchsorted(hot[0], nodes), len(hot[0]) - 1)
        dealt = hot[0][at] == nodes
        third = _node_hashes(w3, nodes) >> np.uint64(20)
        nodes = np.where(dealt, _node_hashes(nodes, third % hot[1][at]), nodes)
    return ((nodes >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int32)


#: Of an edge's row, the words' hashes, ids into these, and counts; of a word's row, hashes, counts and the words.
_PARTS = "lang string, bucket int, hashes binary, a binary, b binary, c binary, counts binary, words array<binary>"
_NAMES = [x.split()[0] for x in _PARTS.split(", ")]


def _edge_rows(lang: str, edges: tuple, hashes: np.ndarray, n_buckets: int, hot) -> Iterator[tuple]:
    a, b, c, counts = edges
    bucket = _buckets(hashes[a], hashes[b], hashes[c], n_buckets, hot)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    local = np.zeros(len(hashes), np.uint32)
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        part = order[cuts[k] : cuts[k + 1]]
        three = [a[part], b[part], c[part]]
        used = np.zeros(len(hashes), bool)
        for ids in three:
            used[ids] = True
        used = np.flatnonzero(used)
        local[used] = np.arange(len(used))
        kind = np.uint16 if len(used) < 1 << 16 else np.uint32
        yield (lang, k, hashes[used].tobytes(), *[local[ids].astype(kind).tobytes() for ids in three], counts[part].astype(np.uint32).tobytes(), None)


def _word_rows(lang: str, edges: tuple, hashes: np.ndarray, words: list[bytes], n_buckets: int) -> Iterator[tuple]:
    """The flow out of each word, which is how often it occurs; word buckets are below zero."""
    flow = np.bincount(edges[0], weights=edges[3], minlength=len(words)).astype(np.uint32)
    here = np.append(0, np.flatnonzero(flow))
    bucket = (hashes[here] % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    here, bucket = here[order], bucket[order]
    cuts = np.searchsorted(bucket, np.arange(n_buckets + 1))
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        part = here[cuts[k] : cuts[k + 1]]
        yield (lang, -1 - k, hashes[part].tobytes(), None, None, None, flow[part].tobytes(), [words[i] for i in part.tolist()])


def _hashes(words: list[bytes], seed: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, np.ndarray], list[bytes]]]:
    """Ids of the words of each language, and the words by id, for about ``_FLUSH`` words at a time."""
    ids, held, size, n_bytes = _Ids({_END: 0}), {}, 0, 0
    for batch in chunks(batches, most_bytes=1 << 21):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if not text:
                continue
            if size and (size + len(text) // 2 > _FLUSH or n_bytes > _FLUSH_BYTES):
                yield {k: np.concatenate(v) for k, v in held.items()}, list(ids)
                ids, held, size, n_bytes = _Ids({_END: 0}), {}, 0, 0
            found = np.array([ids[w] for w in tokens(text)], np.int32)
            held.setdefault(lang, []).append(found)
            size += len(found)
            n_bytes += len(text)
    if size:
        yield {k: np.concatenate(v) for k, v in held.items()}, list(ids)


def _counted(n_buckets: int, hot: dict, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, words in _gathered(batches):
            hashes = _hashes(words, seed)
            for lang, ids in held.items():
                edges = edges_of(ids, len(words))
                rows = [*_edge_rows(lang, edges, hashes, n_buckets, hot.get(lang)), *_word_rows(lang, edges, hashes, words, n_buckets)]
                columns = list(zip(*rows, strict=True))
                types = [pa.string(), pa.int32(), *[pa.binary()] * 5, pa.list_(pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], _NAMES)

    return run


_FLOWS = "lang string, kind string, w1 long, w2 long, w3 long, f long, word binary"


def _flow_table(lang: str, kind: str, f: np.ndarray, *words: np.ndarray, text: list[bytes] | None = None) -> pa.Table:
    n, none = len(f), pa.nulls(len(f), pa.int64())
    ids = [pa.array(w.view(np.int64)) for w in words] + [none] * (3 - len(words))
    columns = [pa.array([lang] * n, pa.string()), pa.array([kind] * n, pa.string()), *ids, pa.array(f.astype(np.int64)), pa.array(text, pa.binary()) if text is not None else pa.nulls(n, pa.binary())]
    return pa.Table.from_arrays(columns, names=[x.split()[0] for x in _FLOWS.split(", ")])


def _word_flows(lang: str, table: pa.Table) -> pa.Table:
    hashes = np.frombuffer(b"".join(table.column("hashes").to_pylist()), np.uint64)
    counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint32).astype(np.int64)
    words = [w for row in table.column("words").to_pylist() for w in row]
    order = np.argsort(hashes, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], np.diff(hashes[order]) != 0]))
    f = np.add.reduceat(counts[order], starts)
    ends = np.append(starts[1:], len(order))
    often = np.flatnonzero(f >= LEAST)
    text, clash = [], []
    for i in often.tolist():
        same = {words[j] for j in order[starts[i] : ends[i]]}
        text.append(min(same))
        clash.append(len(same) > 1)
    marks = np.flatnonzero([t != _END for t in text]) if text else np.empty(0, np.int64)
    out = _flow_table(lang, "word", f[often][marks], hashes[order[starts[often]]][marks], text=[text[i] for i in marks])
    total = _flow_table(lang, "total", np.array([counts.sum()]))
    clashes = _flow_table(lang, "clash", np.array([sum(clash)])[: any(clash)])
    return pa.concat_tables([out, total, clashes])


def _flows(hot: dict, seed: int):
    """Edges, nodes or words of one bucket that occur ``LEAST`` times; parts of hot nodes always."""
    end = np.uint64(xxhash.xxh64_intdigest(_END, seed))

    def run(table: pa.Table) -> pa.Table:
        lang = table.column("lang")[0].as_py()
        if table.column("bucket")[0].as_py() < 0:
            return _word_flows(lang, table)
        parts: list[list[np.ndarray]] = [[], [], [], []]
        for hashes, a, b, c, counts in zip(*[table.column(x).to_pylist() for x in ("hashes", "a", "b", "c", "counts")], strict=True):
            hashes, counts = np.frombuffer(hashes, np.uint64), np.frombuffer(counts, np.uint32)
            kind = np.uint16 if len(a) == 2 * len(counts) else np.uint32
            for to, ids in zip(parts, (a, b, c), strict=False):
                to.append(hashes[np.frombuffer(ids, kind)])
            parts[3].append(counts)
        a, b, c, counts = (np.concatenate(x) for x in parts)
        del parts
        order = np.lexsort((c, b, a))
        a, b, c, counts = a[order], b[order], c[order], counts[order].astype(np.int64)
        node_new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        new = np.flatnonzero(node_new | np.concatenate([[True], c[1:] != c[:-1]]))
        f = np.add.reduceat(counts, new)
        stay = new[(f >= LEAST) & (c[new] != end)]
        edges = _flow_table(lang, "edge", f[(f >= LEAST) & (c[new] != end)], a[stay], b[stay], c[stay])
        new = np.flatnonzero(node_new)
        f = np.add.reduceat(counts, new)
        split = np.isin(_node_hashes(a[new], b[new]), hot[lang][0]) if lang in hot else False
        keep = ((f >= LEAST) | split) & (b[new] != end)
        return pa.concat_tables([edges, _flow_table(lang, "node", f[keep], a[new[keep]], b[new[keep]])])

    return run


def _sampled(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, words in _gathered(batches):
            hashes = _hashes(words, seed)
            for lang, ids in held.items():
                a, b, _, counts = edges_of(ids, len(words))
                new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.empty(0, np.int64)
                if not len(new):
                    continue
                n = np.add.reduceat(counts, new)
                new, n = new[n > 1], n[n > 1]
                node = _node_hashes(hashes[a[new]], hashes[b[new]]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(new), pa.string()), pa.array(node), pa.array(n.astype(np.int64))], ["lang", "node", "n"])

    return run


def hot_nodes(texts: DataFrame, n_words: int, seed: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """By language, the nodes that would take more than a quarter of a bucket (or a millionth of all
    words), sorted, and over how many buckets each is dealt."""
    part = max(BUCKET_EDGES // 4, n_words // MOST_HOT)
    share = min(1.0, max(SAMPLE_WORDS, n_words // 1000) / max(1, n_words))
    found = texts.sample(share, seed=1).mapInArrow(freed(_sampled(seed)), "lang string, node long, n long").groupBy("lang", "node").agg(F.sum("n").alias("n"))
    rows = found.where(F.col("n") > part * share).collect()
    hot: dict[str, list] = {}
    for r in rows:
        hot.setdefault(r.lang, []).append((r.node % 2**64, int(r.n / share / part) + 1))
    return {k: (np.array([x for x, _ in sorted(v)], np.uint64), np.array([x for _, x in sorted(v)], np.uint64)) for k, v in hot.items()}


def counted(docs: DataFrame) -> DataFrame:
    """(lang, kind, w1, w2, w3, f, word): words, nodes and edges that occur ``LEAST`` times, and each
    language's number of words, stored."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), utf8("text").alias("text"))
    n_words = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6
    n_buckets = buckets_for(spark, n_words, BUCKET_EDGES)
    for seed in range(100):
        hot = hot_nodes(texts, n_words, seed)
        parts = texts.mapInArrow(freed(_counted(n_buckets, hot, seed)), _PARTS)
        flows = stored(parts.groupBy("lang", "bucket").applyInArrow(_flows(hot, seed), _FLOWS), "phrase-flows")
        if not flows.where("kind = 'clash'").limit(1).count():
            return flows
    raise RuntimeError("two frequent words share their hash under each seed")


def _linked(edges: DataFrame) -> DataFrame:
    """(eid, before): an edge and the one before it, where the node between has no other edge."""
    out = edges.select("lang", F.col("w1").alias("x"), F.col("w2").alias("y"), F.lit(None).cast("long").alias("into"), F.col("eid").alias("out"))
    into = edges.select("lang", F.col("w2").alias("x"), F.col("w3").alias("y"), F.col("eid").alias("into"), F.lit(None).cast("long").alias("out"))
    met = out.unionByName(into).groupBy("lang", "x", "y").agg(F.count("into").alias("n_in"), F.count("out").alias("n_out"), F.max("into").alias("before"), F.max("out").alias("eid"))
    return met.where("n_in = 1 AND n_out = 1").select("eid", "before")


def _placed(edges: DataFrame) -> DataFrame:
    """(eid, head, far): each edge's first edge of its path and the distance from it, by doubling."""
    first = edges.select("eid").join(_linked(edges), "eid", "left")
    state = stored(first.select("eid", F.coalesce("before", "eid").alias("head"), F.when(F.col("before").isNull(), 0).otherwise(1).cast("long").alias("far"), F.col("before").isNull().alias("done")), "path-pointers")
    open_before = None
    while (left := state.where("NOT done").count()) and left != open_before:
        open_before = left
        ahead = state.select(F.col("eid").alias("head"), F.col("head").alias("next"), F.col("far").alias("more"), F.col("done").alias("ends"))
        moved = state.where("NOT done").join(ahead, "head").select("eid", F.col("next").alias("head"), (F.col("far") + F.col("more")).alias("far"), F.col("ends").alias("done"))
        state = stored(state.where("done").unionByName(moved), "path-pointers")
    ring = ~F.col("done")
    return state.select("eid", F.when(ring, F.col("eid")).otherwise(F.col("head")).alias("head"), F.when(ring, 0).otherwise(F.col("far")).alias("far"))


def paths(flows: DataFrame) -> DataFrame:
    """(lang, edges): unary paths of the graph of frequent edges.  ``edges`` is in order, each with its words,
    its occurrences ``f``, and those of the nodes before and behind it."""
    edges = stored(flows.where("kind = 'edge'").select("lang", "w1", "w2", "w3", "f").withColumn("eid", F.monotonically_increasing_id()), "phrase-edges")
    nodes = nodes_of(flows)
    tail = nodes.select("lang", "w1", "w2", F.col("f").alias("tail_f"))
    head = nodes.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("f").alias("head_f"))
    whole = edges.join(_placed(edges), "eid").join(tail, ["lang", "w1", "w2"]).join(head, ["lang", "w2", "w3"])
    by = whole.groupBy("lang", "head", F.floor(F.col("far") / PATH_EDGES).alias("block"))
    return by.agg(F.sort_array(F.collect_list(F.struct("far", "w1", "w2", "w3", "f", "tail_f", "head_f"))).alias("edges")).select("lang", "edges")


def nodes_of(flows: DataFrame) -> DataFrame:
    """(lang, w1, w2, f) of nodes; those dealt over several buckets are added here."""
    return flows.where("kind = 'node'").groupBy("lang", "w1", "w2").agg(F.sum("f").alias("f")).where(F.col("f") >= LEAST)


def candidates(flows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Phrases of three words (lang, w1, w2, w3, a, ab, bc), with the counts of their nodes, and phrases
    of two (lang, w1, w2, a) that are in no longer one with ``INSIDE_PERCENT`` of their occurrences."""
    chains = stored(paths(flows), "phrase-paths")
    edge = chains.select("lang", F.explode("edges").alias("e"))
    long = edge.select("lang", "e.w1", "e.w2", "e.w3", F.col("e.f").alias("a"), F.col("e.tail_f").alias("ab"), F.col("e.head_f").alias("bc"))
    place = lambda w1, w2, best: F.struct(w1.alias("w1"), w2.alias("w2"), best.alias("best"))
    e, n = F.col("edges"), F.size("edges")
    first, last = F.element_at(e, 1), F.element_at(e, -1)
    inner = F.transform(F.slice(e, 1, n - 1), lambda x, i: place(x["w2"], x["w3"], F.greatest(x["f"], F.get(e, i + 1)["f"])))
    ends = F.array(place(first["w1"], first["w2"], first["f"]), place(last["w2"], last["w3"], last["f"]))
    met = chains.select("lang", F.explode(F.concat(inner, ends)).alias("p")).select("lang", "p.*").groupBy("lang", "w1", "w2").agg(F.max("best").alias("best"))
    rare = F.col("best").isNull() | (100 * F.col("best").cast("decimal(20,0)") < INSIDE_PERCENT * F.col("f").cast("decimal(20,0)"))
    short = nodes_of(flows).join(met, ["lang", "w1", "w2"], "left").where(rare)
    return long, short.select("lang", "w1", "w2", F.col("f").alias("a"))


_SCORED = "lang string, phrase string, a long, l long, r long, score long"


def best_cut(a: int, cuts: list[tuple[int, int]]) -> tuple[int, int, int]:
    """(score, l, r) of the cut with the least score, the first of several."""
    scores = [1_000_000 * a * a // (left * right) for left, right in cuts]
    k = scores.index(min(scores))
    return scores[k], *cuts[k]


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            words, cuts = [r["t1"], r["t2"]], [(r["f1"], r["f2"])]
            if r["w3"] is not None:
                words, cuts = [*words, r["t3"]], [(r["f1"], r["bc"]), (r["ab"], r["f3"])]
            score, left, right = best_cut(r["a"], cuts)
            rows.append((r["lang"], b" ".join(words).decode("utf-8", "replace"), r["a"], left, right, score))
        columns = list(zip(*rows, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), *[pa.int64()] * 4), strict=True)], [x.split()[0] for x in _SCORED.split(", ")])


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    flows = counted(docs)
    words = flows.where("kind = 'word'")

    def told(rows: DataFrame, places: tuple[int, ...]) -> DataFrame:
        for i in places:
            rows = rows.join(words.select("lang", F.col("w1").alias(f"w{i}"), F.col("f").alias(f"f{i}"), F.col("word").alias(f"t{i}")), ["lang", f"w{i}"])
        return rows

    long, short = candidates(flows)
    rows = told(long, (1, 2, 3)).unionByName(told(short, (1, 2)), allowMissingColumns=True)
    scored = rows.mapInArrow(freed(_scored), _SCORED).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    best = scored
    for by in (["lang", "part"], ["lang"]):  # a language's first ones are among the first of its parts
        order = Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("a"), "phrase")
        best = best.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    n = flows.where("kind = 'total'").groupBy("lang").agg(F.sum("f").alias("n"))
    return best.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))
