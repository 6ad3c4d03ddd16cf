"""Toxicity scores by weak supervision.

Voters are words (a lexicon) and beginnings of words of 4 to 8 bytes (patterns, which catch stems
with any ending).  They are mined from the labelled rows of the training folds, of which at most
``SAMPLE`` enter (those with the least hash of their id): a voter must stand in ``LEAST`` toxic ones
and its precision's lower bound must pass ``PRECISION``.  Every feature that does is a voter; one
that stands with a more frequent one in ``TIED`` of its texts shares that one's source.

A generative label model then explains the sources' votes on all documents of the training folds,
labelled or not.  Its accuracies are each source's rates of firing in toxic and in other texts, its
correlations the rates given that the source it depends on most fires too: the sources form a tree
of greatest mutual information within the classes.  Expectation maximisation starts from the labelled
rows; in each round a labelled row counts by its label and any other by its posterior, once.  The
posteriors by votes alone label the sample, and a logistic regression on the sources is trained on
them; that any source votes has a weight of its own, so a rare source starts from what all of them
tell.  Every text is scored whole, by the distinct words in it.

Inputs of a score are words only.  Nulls: a null or empty text gets the score of no votes; labels
that are null or without a document are passed over, of several labels of one id the greatest
counts.  Without toxic training rows, or of an empty table, every score is 0.  Repeated rows get
equal scores, and ties between voters are broken by their bytes.  Long texts are scored in batches
of bounded bytes.  Columns besides ``doc_id`` and ``text`` are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglathe.llm.common import LONGEST_CACHED, chunks, crc_mod, freed, read_table, small_batches, stored, utf8

FOLDS = 5
SAMPLE = 20_000
LEAST, PRECISION, TIED = 5, 0.6, 0.9
STEMS = (4, 5, 6, 7, 8)
ROUNDS = 6
#: Twice the log likelihood that a dependency between two sources must gain.
EVIDENCE = 20.0
MOST_CACHED = 120_000
#: Posteriors count in whole millionths, so sums don't depend on the order of rows.
_UNIT = 1_000_000
_FLUSH = 200_000

_SPACES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: bytes) -> set[bytes]:
    return set(text.decode().lower().encode().translate(_SPACES).split())


def features_of(word: bytes) -> list[bytes]:
    """The word, and its beginnings marked with a star."""
    return [word, *[word[:n] + b"*" for n in STEMS if len(word) > n]]


def _features(text: bytes) -> set[bytes]:
    return {f for w in words_of(text) for f in features_of(w)}


def training_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the training folds, one row an id."""
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", FOLDS) != 0))
    return own.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))


def sample_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of at most ``SAMPLE`` labelled training rows."""
    own = training_labels(labels)
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    return docs.select("doc_id", utf8("text").alias("text")).join(F.broadcast(own), "doc_id").select("text", "toxic")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(f, hits, misses): toxic and other texts that hold a feature."""
    counts: tuple[Counter[bytes], Counter[bytes]] = (Counter(), Counter())

    def flush() -> Iterator[pa.RecordBatch]:
        misses, hits = counts
        found = list(misses | hits)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), *[pa.array([c[f] for f in found], pa.int64()) for c in (hits, misses)]], ["f", "hits", "misses"])
        misses.clear()
        hits.clear()

    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            if toxic in (0, 1):
                counts[toxic].update(_features(text))
            if len(counts[0]) + len(counts[1]) >= _FLUSH:
                yield from flush()
    yield from flush()


def mine(sample: DataFrame) -> list[bytes]:
    """The voters: all features that toxic rows have and others hardly.  Features are counted and
    judged in Spark; only voters come to the driver."""
    n_toxic, n_other = (sample.where(F.col("toxic") == t).count() for t in (1, 0))
    found = sample.mapInArrow(freed(_count), "f binary, hits long, misses long").groupBy("f").agg(F.sum("hits").alias("c"), F.sum("misses").alias("misses"))
    found = found.where(F.col("c") >= LEAST).select("f", "c", (F.col("c") + F.col("misses")).cast("double").alias("n"))
    n, p = F.col("n"), F.col("c") / F.col("n")
    lower = (p + 2 / n - 2 * F.sqrt(p * (1 - p) / n + 1 / (n * n))) / (1 + 4 / n)  # Wilson, z = 2
    keep = lower >= PRECISION
    if n_other:
        keep |= (p * n_other > 20 * (1 - p) * n_toxic) & (F.col("c") >= 4 * LEAST)
    return [f for _, f in sorted((-r.c, bytes(r.f)) for r in found.where(keep).collect())]


@dataclass(frozen=True)
class Model:
    #: Source of each voter, weight of each source, of any vote at all, and of none.
    source: dict[bytes, int]
    weights: np.ndarray
    any: float
    bias: float

    def votes(self, words: set[bytes], cache: dict[bytes, tuple[int, ...]]) -> set[int]:
        found: set[int] = set()
        for w in words:
            own = cache.get(w)
            if own is None:
                if len(cache) >= MOST_CACHED:
                    cache.clear()
                own = tuple({self.source[f] for f in features_of(w) if f in self.source})
                if len(w) <= LONGEST_CACHED:
                    cache[w] = own
            if own:
                found.update(own)
        return found

    def score(self, votes: set[int]) -> float:
        z = self.bias + (self.any if votes else 0) + sum(self.weights[i] for i in sorted(votes))
        return float(1 / (1 + np.exp(-z)))


def merge_tied(votes: np.ndarray, times: np.ndarray) -> np.ndarray:
    """A source for each voter: one that hardly votes without another, more frequent one depends on
    it and shares its source.  ``times`` tells how often each row of votes (0/1) occurs."""
    v = votes.shape[1]
    both = (votes * times[:, None]).T @ votes
    count = both.diagonal()
    source = np.full(v, -1)
    found = 0
    for i in np.argsort(-count, kind="stable"):
        heads = np.flatnonzero((source >= 0) & (both[i] >= TIED * count[i]))
        if len(heads):
            source[i] = source[heads[both[i, heads].argmax()]]
        else:
            source[i], found = found, found + 1
    return source


def dependencies(votes: np.ndarray, labels: np.ndarray, times: np.ndarray) -> list[int]:
    """For each source the one that it depends on, or -1: the forest in which the mutual information
    of joined sources, given the label, is greatest.  A join must gain ``EVIDENCE``."""
    n_sources = votes.shape[1]
    gain = np.zeros((n_sources, n_sources))
    for y in (0, 1):
        own = votes[labels == y]
        weight = times[labels == y]
        n = weight.sum()
        both = (own * weight[:, None]).T @ own
        c = both.diagonal()
        for cells, a, b in ((both, c[:, None], c), (c[:, None] - both, c[:, None], n - c), (c - both, n - c[:, None], c), (n - c[:, None] - c + both, n - c[:, None], n - c)):
            expected = a * b / max(n, 1)
            gain += 2 * np.where(cells > 0, cells * np.log(np.maximum(cells, 1e-9) / np.maximum(expected, 1e-9)), 0)
    parent, best, joined = np.full(n_sources, -1), np.full(n_sources, EVIDENCE), np.zeros(n_sources, bool)
    for _ in range(n_sources):
        i = int(np.where(joined, -np.inf, best).argmax())
        joined[i] = True
        nearer = ~joined & (gain[i] > best)
        parent[nearer], best[nearer] = i, gain[i][nearer]
    return parent.tolist()


@dataclass(frozen=True)
class LabelModel:
    """Log odds of toxic given the votes: those of no vote, and what each vote adds where the source
    it depends on is silent or votes too."""

    parent: list[int]
    gain: np.ndarray
    base: float

    def logit(self, votes: set[int]) -> float:
        return float(self.base + sum(self.gain[i, int(self.parent[i] in votes)] for i in sorted(votes)))

    def posterior(self, votes: set[int]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(votes), -30, 30))))


def estimate(parent: list[int], on: np.ndarray, total: np.ndarray) -> LabelModel:
    """The model of counts: ``on[i, a, y]`` tells in how many texts of class y source i votes while
    its parent votes (a = 1) or not, ``total[y]`` how many texts the class has."""
    up = np.array(parent, int)
    alone = on.sum(1)
    given = np.where((up >= 0)[:, None], alone[up], 0)  # texts in which the parent votes
    texts = np.stack([total - given, given], 1)
    usual = (alone + np.array([0.01, 0.1])) / (total + 1)
    rates = np.clip((on + usual[:, None, :]) / (texts + 1), 1e-7, 0.999)
    yes, no = np.log(rates[..., 1] / rates[..., 0]), np.log((1 - rates[..., 1]) / (1 - rates[..., 0]))
    gain = yes - no
    for i, p in enumerate(parent):
        if p >= 0:  # what i's silence tells, where its parent votes
            gain[p] += no[i, 1] - no[i, 0]
    return LabelModel(parent, gain, float(np.log((total[1] + 1) / (total[0] + 1)) + no[:, 0].sum()))


def tally(rows, model: LabelModel | None, parent: list[int]) -> Counter:
    """Counts of (source, parent votes, class), and of (-1, 0, class) for all texts, in units.  A
    row without a label counts by its posterior, or not at all without a model."""
    found: Counter = Counter()
    for v, toxic, times in rows:
        if toxic is None and model is None:
            continue
        votes = set(v)
        p = round(_UNIT * (toxic if toxic is not None else model.posterior(votes)))
        for y, w in ((1, p * times), (0, (_UNIT - p) * times)):
            if w:
                found[-1, 0, y] += w
                for i in votes:
                    found[i, int(parent[i] in votes), y] += w
    return found


def label_model(patterns: DataFrame, parent: list[int]) -> LabelModel:
    """Expectation maximisation over (v, toxic, times), the votes on all training documents; only
    counts by source come to the driver."""
    model = None
    for _ in range(ROUNDS):
        now = model

        def run(batches: Iterator[pa.RecordBatch], now: LabelModel | None = now) -> Iterator[pa.RecordBatch]:
            found: Counter = Counter()
            for batch in batches:
                found.update(tally(zip(*[c.to_pylist() for c in batch.columns], strict=True), now, parent))
            if found:
                cells = [pa.array(c, pa.int32()) for c in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([*cells, pa.array(found.values(), pa.int64())], ["i", "a", "y", "w"])

        on, total = np.zeros((len(parent), 2, 2)), np.zeros(2)
        for r in patterns.mapInArrow(run, "i int, a int, y int, w long").groupBy("i", "a", "y").agg(F.sum(F.col("w").cast("decimal(38,0)")).alias("w")).collect():
            if r.i < 0:
                total[r.y] = float(r.w) / _UNIT
            else:
                on[r.i, r.a, r.y] = float(r.w) / _UNIT
        model = estimate(parent, on, total)
    return model


def logistic(x: np.ndarray, y: np.ndarray, times: np.ndarray, ridge: float = 0.2, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Weights and bias fitted to soft labels by Newton steps; the last weight and the bias are hardly
    shrunk."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], ridge)
    shrink[-2:] = 0.01, 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (times * (p - y)) + shrink * w
        curve = (x * (times * (p * (1 - p) + 1e-6))[:, None]).T @ x + np.diag(shrink)
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def votes_on(docs: DataFrame, source: dict[bytes, int], *keep: str) -> DataFrame:
    """``keep`` and v, the sources that vote on a text."""
    shared = docs.sparkSession.sparkContext.broadcast(Model(source, np.zeros(0), 0.0, 0.0))  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cache = shared.value, {}
        for batch in chunks(batches):
            rows = [sorted(own.votes(words_of(t), cache)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(rows, pa.list_(pa.int32()))], [*keep, "v"])

    types = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keep)
    return docs.select(*keep, "text").mapInArrow(freed(run), f"{types}, v array<int>")


def vote_patterns(docs: DataFrame, labels: DataFrame, source: dict[bytes, int]) -> DataFrame:
    """(v, toxic, times): votes on all training documents, with the label where there is one.  Only
    ids and votes are shuffled; rows without an id have no label and skip the join."""
    own = docs.where(crc_mod("doc_id", FOLDS) != 0).select("doc_id", utf8("text").alias("text"))
    voted = stored(votes_on(own, source, "doc_id"), "votes")
    known = voted.where("doc_id IS NOT NULL").join(training_labels(labels), "doc_id", "left").select("v", "toxic")
    unknown = voted.where("doc_id IS NULL").select("v", F.lit(None).cast("int").alias("toxic"))
    return stored(known.union(unknown).groupBy("v", "toxic").agg(F.count("*").alias("times")), "vote-patterns")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    small_batches(docs.sparkSession)
    sample = sample_of(docs, labels).persist()
    try:
        voters = mine(sample)
        if not voters:
            return Model({}, np.zeros(0), 0.0, -30.0)
        rows = votes_on(sample, {f: i for i, f in enumerate(voters)}, "toxic").groupBy("v", "toxic").agg(F.count("*").alias("times"))
        rows = sorted((r.v, r.toxic, r.times) for r in rows.collect())  # SAMPLE rows of voter numbers at most
    finally:
        sample.unpersist()
    times, marked = np.array([t for *_, t in rows], float), np.array([t for _, t, _ in rows])
    votes = np.zeros((len(rows), len(voters)), np.float32)
    for i, (v, *_) in enumerate(rows):
        votes[i, v] = 1
    source = merge_tied(votes, times.astype(np.float32))
    merged = np.zeros((len(rows), source.max() + 1))
    for j, s in enumerate(source):
        merged[:, s] = np.maximum(merged[:, s], votes[:, j])
    by_voter = {f: int(s) for f, s in zip(voters, source, strict=True)}
    model = label_model(vote_patterns(docs, labels, by_voter), dependencies(merged, marked, times))
    post = np.array([model.posterior({int(source[j]) for j in v}) for v, *_ in rows])
    weights, bias = logistic(np.column_stack([merged, merged.any(1)]), post, times)
    return Model(by_voter, weights[:-1], float(weights[-1]), bias)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a weight for each source

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cache = shared.value, {}
        for batch in chunks(batches):
            scores = [own.score(own.votes(words_of(t), cache)) for t in batch.column("text").to_pylist()]
            predicted = pa.array([int(s >= 0.5) for s in scores], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), predicted], ["doc_id", "held_out", "score", "predicted"])

    held_out = crc_mod("doc_id", FOLDS) == 0
    return docs.select("doc_id", held_out.alias("held_out"), utf8("text").alias("text")).mapInArrow(freed(run), "doc_id long, held_out boolean, score double, predicted int")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scored(docs, train(docs, read_table(spark, sf_dir, "labels")))
