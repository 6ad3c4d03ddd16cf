"""Greedy longest-match token counts by a linear automaton.

A word is a run of other bytes than the six white space ones, A-Z lower-cased; its symbols are its
bytes, the last one marked as the end.  The vocabulary (by default the labels of a public
tokenizer) becomes a trie over these symbols.  Each node has a failure link: the node reached after
popping longest-match tokens off its string's front until what is left is in the trie; and the
number of tokens popped.  A word's count then takes one pass over its symbols, adding the counts
of the links followed, and no piece is ever built.

A word with a symbol outside the vocabulary counts as one unknown token.  A null text has no
words; repeated rows give repeated results; an empty table gives an empty result.  A very long text or
word takes one pass and memory in proportion to its bytes.  Extra columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglathe.llm.bpe import byte_letters, default_path, digest, load
from loglathe.llm.common import LONGEST_CACHED, chunks, freed, read_table, small_batches, utf8

MOST_CACHED = 120_000
_END = 256  # added to the last byte of a word


def vocabulary(tokens: Iterable[str], suffix: str, special: Iterable[str]) -> list[tuple[int, ...]]:
    """Labels as symbol sequences."""
    byte = {c: b for b, c in enumerate(byte_letters())}
    out = []
    for t in set(tokens) - set(special):
        ends = bool(suffix) and t.endswith(suffix)
        symbols = [byte[c] for c in (t.removesuffix(suffix) if ends else t)]
        if symbols:
            symbols[-1] += _END * ends
            out.append(tuple(symbols))
    return out


class LongestMatch:
    """Trie with failure links and popped-token counts."""

    def __init__(self, words: Iterable[tuple[int, ...]]):
        self.next: list[dict[int, int]] = [{}]
        token = [False]
        for w in words:
            node = 0
            for s in w:
                child = self.next[node].get(s)
                if child is None:
                    child = self.next[node][s] = len(self.next)
                    self.next.append({})
                    token.append(False)
                node = child
            token[node] = True
        n = len(self.next)
        #: Node after popping, -1 where nothing can be popped; tokens popped on the way.
        self.link, self.popped = [-1] * n, [0] * n
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for symbol, node in self.next[parent].items():
                queue.append(node)
                if token[node]:
                    self.link[node], self.popped[node] = 0, 1
                    continue
                at, count = self.link[parent], self.popped[parent]
                while at >= 0 and symbol not in self.next[at]:
                    count += self.popped[at]
                    at = self.link[at]
                if at >= 0:
                    self.link[node], self.popped[node] = self.next[at][symbol], count

    def count(self, symbols: Iterable[int]) -> int:
        """Tokens of one word, 1 if it can't be covered."""
        node, total = 0, 0
        for s in symbols:
            while s not in self.next[node]:
                total += self.popped[node]
                node = self.link[node]
                if node < 0:
                    return 1
            node = self.next[node][s]
        while node > 0:
            total += self.popped[node]
            node = self.link[node]
        return total if node == 0 else 1

    def word(self, data: bytes) -> int:
        symbols = list(data)
        symbols[-1] += _END
        return self.count(symbols)


_held: dict[str, tuple[LongestMatch, dict[bytes, int]]] = {}


def _compiled(key: str, broadcast: object) -> tuple[LongestMatch, dict[bytes, int]]:
    """The worker's one automaton and its word cache, under its file's digest."""
    if key not in _held:
        _held.clear()
        tokens, _, suffix, special = broadcast.value
        _held[key] = LongestMatch(vocabulary(tokens, suffix, special)), {}
    return _held[key]


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens, most_in_word) of each row; most_in_word: tokens of its longest word."""
    path = path or default_path()
    small_batches(docs.sparkSession)
    key, tables = digest(path), docs.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, cache = _compiled(key, tables)
        for batch in chunks(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                words = text.lower().split()  # of bytes: only A-Z change
                missing = {w for w in words if len(w) <= LONGEST_CACHED and w not in cache}
                if len(cache) + len(missing) > MOST_CACHED:
                    cache.clear()
                    missing = {w for w in words if len(w) <= LONGEST_CACHED}
                for w in missing:
                    cache[w] = automaton.word(w)
                counts = [cache.get(w) or automaton.word(w) for w in words]
                rows.append((len(words), sum(counts), max(counts, default=0)))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_words", "n_tokens", "most_in_word"])

    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    return df.mapInArrow(freed(run), "doc_id long, n_words long, n_tokens long, most_in_word long")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"))
