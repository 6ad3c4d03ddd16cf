"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of order ``ORDER`` over the characters of lower-cased words, with an edge
before and after each word.  The highest order uses counts, lower ones the number of different
characters seen before; the discount of an order is n1 / (n1 + 2 n2).  Models are fitted on about
``PER_LANGUAGE`` documents of each language in the training folds, chosen by a hash of the id (a
bounded sample), and kept as arrays sorted by n-gram hash, one column a language, so one binary
search serves all of them.

A text's cross-entropy is the mean over its characters, words and edges; the least wins.  ``score``
is its share among the languages' likelihoods, tempered by ``SHARPNESS`` and the length.  A text is
``rejected`` if its cross-entropy passes ``REJECT`` times the ``QUANTILE`` of its language's
calibration texts: a fifth of the sample, scored by models fitted on the rest.  The final models are
fitted on the whole sample; a language without calibration texts rejects none.  The prediction is
given all the same.

Nulls: a null text, or one without a letter, is ``und`` with score 0.  Without training rows, or of
an empty table, every text is ``und``.  Repeated rows get equal results, and of languages with equal
cross-entropy the first by name wins.  Long texts are scored whole, in batches of bounded bytes.
Columns besides ``doc_id``, ``text`` and ``lang`` are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglathe.llm.common import bounded_broadcast, chunks, crc_mod, freed, read_table, small_batches, utf8

FOLDS, HELD_OUT = 3, 1
#: One in so many sampled documents calibrates the rejection.
CALIBRATION = 5
ORDER = 4
PER_LANGUAGE = 400
SHARPNESS = 0.5
QUANTILE, REJECT = 99.5, 1.1
MOST_CACHED, MOST_BYTES, SLICE_BYTES = 120_000, 8 << 20, 1 << 18
UND = "und"

_SPACES = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_LETTER = regex.compile(r"\p{L}")
_EDGE = 1
_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(ORDER)]


def words_of(text: bytes) -> list[bytes]:
    return text.decode().lower().encode().translate(_SPACES).split()


def has_letter(text: bytes) -> bool:
    return _LETTER.search(text.decode()) is not None


def _codes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all words, each with ORDER - 1 edges before it and one after, and the lengths
    with the last edge."""
    decoded = [w.decode("utf-8", "replace") for w in words]
    lengths = np.array([len(w) + 1 for w in decoded])
    text = "".join(chr(_EDGE) * (ORDER - 1) + w + chr(_EDGE) for w in decoded)
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64), lengths


def _grams(words: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order k from 0 the hash of the k characters that end at each predicted one (of
    order 0: all alike), and the words' lengths."""
    codes, lengths = _codes(words)
    ends = np.cumsum(lengths + ORDER - 1)
    at = np.concatenate([np.arange(e - n, e) for e, n in zip(ends, lengths, strict=True)]) if len(words) else np.empty(0, np.int64)
    hashes, h = [np.zeros(len(at), np.uint64)], np.zeros(len(at), np.uint64)
    for k in range(ORDER):
        h = h + (codes[at - k] + np.uint64(7)) * _POWERS[k]
        mixed = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(k)
        hashes.append(mixed ^ (mixed >> np.uint64(29)))
    return hashes, lengths


def _contexts(words: list[bytes]) -> list[np.ndarray]:
    """For each order k from 0 the hash of the k characters before each predicted one."""
    codes, lengths = _codes(words)
    ends = np.cumsum(lengths + ORDER - 1)
    at = np.concatenate([np.arange(e - n, e) for e, n in zip(ends, lengths, strict=True)]) if len(words) else np.empty(0, np.int64)
    hashes, h = [np.zeros(len(at), np.uint64)], np.zeros(len(at), np.uint64)
    for k in range(ORDER - 1):
        h = h + (codes[at - k - 1] + np.uint64(7)) * _POWERS[k]
        mixed = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + np.uint64(k)
        hashes.append(mixed ^ (mixed >> np.uint64(29)))
    return hashes


@dataclass
class Models:
    """Sorted hashes with a column for each language: what an n-gram adds, and what its context
    leaves to the order below."""

    languages: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    contexts: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    limits: np.ndarray = field(default_factory=lambda: np.empty(0))

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Negative log likelihood of each word in each language, and characters in it."""
        if not words:
            return np.zeros((0, len(self.languages))), np.zeros(0)
        grams, lengths = _grams(words)
        contexts = _contexts(words)
        p = np.full((len(grams[0]), len(self.languages)), 1e-5)
        for k in range(1, ORDER + 1):
            p = _look(self.grams[k - 1], grams[k], 0.0) + _look(self.contexts[k - 1], contexts[k - 1], 1.0) * p
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        return np.add.reduceat(-np.log(p), starts, axis=0), lengths.astype(float)


def _look(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, default: float) -> np.ndarray:
    hashes, values = table
    at = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
    return np.where((hashes[at] == keys)[:, None], values[at], default)


def fit(counts: dict[str, Counter]) -> Models:
    """Models from word counts by language."""
    languages = sorted(counts)
    added: list[dict[int, np.ndarray]] = [defaultdict(lambda: np.zeros(len(languages))) for _ in range(ORDER)]
    left: list[dict[int, np.ndarray]] = [defaultdict(lambda: np.ones(len(languages))) for _ in range(ORDER)]
    for column, language in enumerate(languages):
        words = sorted(counts[language])
        weight = np.array([counts[language][w] for w in words])
        grams, lengths = _grams(words)
        contexts = _contexts(words)
        each = np.repeat(weight, lengths)
        for k in range(1, ORDER + 1):
            if k == ORDER:
                own, first, inverse = np.unique(grams[k], return_index=True, return_inverse=True)
                c = np.bincount(inverse, each)
            else:  # how many different characters stand before
                _, wider = np.unique(grams[k + 1], return_index=True)
                own, first, inverse = np.unique(grams[k][wider], return_index=True, return_inverse=True)
                c, first = np.bincount(inverse).astype(float), wider[first]
            n1, n2 = (c == 1).sum(), (c == 2).sum()
            discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            context, of = np.unique(contexts[k - 1][first], return_inverse=True)
            total, kinds = np.bincount(of, c), np.bincount(of)
            for g, v in zip(own.tolist(), np.maximum(c - discount, 0) / total[of], strict=True):
                added[k - 1][g][column] = v
            for h, v in zip(context.tolist(), discount * kinds / total, strict=True):
                left[k - 1][h][column] = v
    arrays = lambda d: (np.array(sorted(d), np.uint64), np.array([d[x] for x in sorted(d)]))
    return Models(languages, [arrays(d) for d in added], [arrays(d) for d in left], np.full(len(languages), np.inf))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for lang, aside, text in zip(*[batch.column(c).to_pylist() for c in ("lang", "aside", "text")], strict=True):
            counts.update((lang, aside, w) for w in words_of(text))
    if counts:
        langs, aside, words = zip(*counts, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array(aside), pa.array(words, pa.binary()), pa.array(counts.values(), pa.int64())], ["lang", "aside", "word", "c"])


def slices(words: list[bytes]) -> Iterator[list[bytes]]:
    """``words`` in order, some at a time: about ``SLICE_BYTES``, or one word that is longer."""
    some, size = [], 0
    for w in words:
        if some and size + len(w) > SLICE_BYTES:
            yield some
            some, size = [], 0
        some.append(w)
        size += len(w)
    if some:
        yield some


class Scorer:
    """Scores texts, keeping the words met."""

    def __init__(self, models: Models):
        self.models = models
        self.known: dict[bytes, int] = {}
        self.size = 0
        self.table = np.empty((0, len(models.languages) + 1))

    def entropies(self, texts: list[list[bytes]]) -> list[np.ndarray | None]:
        """Cross-entropy in each language; None without words.  The last cell is the length."""
        new = list({w for t in texts for w in t if w not in self.known})
        if len(self.known) + len(new) > MOST_CACHED:
            self.known, self.table = {}, self.table[:0]
            new = list({w for t in texts for w in t})
        parts = [self.table]
        for some in slices(new):
            loss, length = self.models.words(some)
            parts.append(np.column_stack([loss, length]))
        for w in new:
            self.known[w] = len(self.known)
        self.table = np.concatenate(parts)
        out: list[np.ndarray | None] = []
        for t in texts:
            total = self.table[list(map(self.known.__getitem__, t))].sum(0) if t else None
            out.append(None if total is None else np.append(total[:-1] / total[-1], total[-1]))
        self.size += sum(map(len, new))
        if self.size > MOST_BYTES:  # long words: the next batch starts anew
            self.known, self.table, self.size = {}, self.table[:0], 0
        return out


def sample_of(docs: DataFrame) -> DataFrame:
    """(lang, text, aside) of about PER_LANGUAGE training documents of each language; those set aside
    calibrate."""
    own = docs.where(F.col("lang").isNotNull() & (crc_mod("doc_id", FOLDS) != HELD_OUT))
    share = own.groupBy("lang").agg((F.lit(PER_LANGUAGE * 1_000_000) / F.count("*")).alias("share"))
    share = bounded_broadcast(share, 10_000)
    return own.join(share, "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("share")).select("lang", utf8("text").alias("text"), (F.pmod(F.xxhash64(F.lit("aside"), "doc_id"), F.lit(CALIBRATION)) == 0).alias("aside"))


def train(docs: DataFrame) -> Models | None:
    small_batches(docs.sparkSession)
    sample = sample_of(docs).persist()
    try:
        words = sample.mapInArrow(freed(_count_words), "lang string, aside boolean, word binary, c long").groupBy("lang", "aside", "word").agg(F.sum("c").alias("c"))
        fitted: dict[str, Counter] = defaultdict(Counter)
        counts: dict[str, Counter] = defaultdict(Counter)
        for r in words.collect():  # a bounded sample's words
            counts[r.lang][bytes(r.word)] += r.c
            if not r.aside:
                fitted[r.lang][bytes(r.word)] += r.c
        if not counts:
            return None
        models = fit(counts)
        trial = fit(fitted) if fitted else models
        shared = sample.sparkSession.sparkContext.broadcast(trial)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            scorer = Scorer(own)
            for batch in chunks(batches):
                found = scorer.entropies([words_of(t) for t in batch.column("text").to_pylist()])
                rows = [(lang, float(e[own.languages.index(lang)])) for lang, e in zip(batch.column("lang").to_pylist(), found, strict=True) if e is not None and lang in own.languages]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["lang", "e"])

        limits = sample.where("aside").mapInArrow(freed(run), "lang string, e double").groupBy("lang").agg(F.percentile("e", QUANTILE / 100).alias("q")).collect()
        for r in limits:
            models.limits[models.languages.index(r.lang)] = REJECT * r.q
        return models
    finally:
        sample.unpersist()


def identified(docs: DataFrame, models: Models | None) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(models)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        scorer = Scorer(own) if own else None
        for batch in chunks(batches):
            texts = batch.column("text").to_pylist()
            words = [words_of(t) if scorer and has_letter(t) else [] for t in texts]
            rows = []
            for e in scorer.entropies(words) if scorer else [None] * len(texts):
                if e is None:
                    rows.append((UND, 0.0, True))
                    continue
                best = int(e[:-1].argmin())
                share = np.exp(-SHARPNESS * e[-1] * (e[:-1] - e[best]))
                rows.append((own.languages[best], float(1 / share.sum()), bool(e[best] > own.limits[best])))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.float64(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *columns], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    held_out = crc_mod("doc_id", FOLDS) == HELD_OUT
    return docs.select("doc_id", held_out.alias("held_out"), utf8("text").alias("text")).mapInArrow(freed(run), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    return identified(docs, train(docs))
