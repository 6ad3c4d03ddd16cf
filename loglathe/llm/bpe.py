"""BPE by a tokenization automaton.

1. Gadgets.  The automaton over tokens has a state for each token just emitted and an arc for each
   that may follow; a path is accepted exactly if it is the tokenization that the merges give.  It
   is compiled by one gadget for each merge (a, b) -> c in order: the state behind ``a`` loses the
   arc ``b``; wherever ``a`` could stand before ``b`` the arc ``c`` is added; ``c`` leads where ``b``
   led.  A full table would have (tokens)^2 cells, so a state is kept as its difference from the
   state that it was split from: ``gone[a, b]`` is the time when ``a`` lost the arc ``b``, and the
   state of ``c`` inherits what the state of ``b`` had lost by the time c was made.
2. Symbols.  Encoding reads bytes (the last one of a word marked), so the arcs' labels are joined to
   one trie with failure links, and the automaton over tokens is made deterministic over symbols: a
   state is the trie node reached and, for it and each node on its failure path, the token before
   that node's string (nodes without children are left out, as nothing goes on from them).  Of the labels that end at a symbol exactly one may follow the token before
   it.  States and transitions enter the table when a text first needs them, and at ``MOST_STATES``
   the table starts anew, also within a word.

So a word takes one table lookup a symbol, forward, and one step back for each token, from the last
token to the first; nothing is tried and taken back.  Decoding emits the arcs' labels, joined as the
vocabulary's decoder does it (it has none, so by a space).

The normalisation is that of ``word_bpe_49k.json``: NFC, white space runs to one space, lower case
letter by letter; its two special tokens are matched in the raw text.  Where the tokenizer's
library has other Unicode tables than Python, ``unicode_differences`` finds the code points and the
splitter follows the library.

A null or empty text has no tokens; repeated rows give repeated results, ties there are none; a
text of any length takes time and memory in proportion to it, in one task; columns other than id
and text are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglathe.llm.common import chunks, freed, read_table, release_memory, small_batches, utf8

#: Most words of a worker's word cache, and bytes of a word in it; a full one is emptied.
MOST_CACHED, LONGEST_CACHED = 150_000, 64
#: Most states in a worker's transition table; a full one is emptied.
MOST_STATES = 200_000
_NEVER = 1 << 60
_LAST = 256  # added to the last byte of a word


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it is visible in Latin-1, else the next
    unused one from U+0100 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in visible)
    moved = {b: chr(256 + i) for i, b in enumerate(others)}
    return [chr(b) if b in visible else moved[b] for b in range(256)]


# --- text to words


@dataclass(frozen=True)
class Differences:
    """Where the library's Unicode tables differ from Python's: what single characters normalise to,
    characters that don't reorder or compose, and those added to and taken from \\p{L}, \\p{N}, \\s."""

    becomes: dict[int, str] = field(default_factory=dict)
    inert: str = ""
    added: dict[str, str] = field(default_factory=dict)
    taken: dict[str, str] = field(default_factory=dict)


_CLASSES = {"L": r"\p{L}", "N": r"\p{N}", "s": r"\s"}
#: A character that nothing composes with.
_APART = "\x01"


def _lowered(text: str) -> str:
    return text.replace("Σ", "σ").lower()


def unicode_differences(path: str) -> Differences:
    """Ask the installed tokenizer library how it treats every code point."""
    from tokenizers import Regex, Tokenizer
    from tokenizers.normalizers import NFC
    from tokenizers.pre_tokenizers import Split

    normalizer, nfc = Tokenizer.from_file(path).normalizer, NFC()
    points = regex.findall(r"[^\p{Cn}\p{Co}\p{Cs}\x00-\x7f]", "".join(map(chr, range(sys.maxunicode + 1))))
    spaced = _APART.join(points)
    theirs = dict(zip(points, normalizer.normalize_str(spaced).split(_APART), strict=True))
    composed = dict(zip(points, nfc.normalize_str(spaced).split(_APART), strict=True))
    ours = {c: unicodedata.normalize("NFC", c) for c in points}
    inert = {c for c in points if composed[c] != ours[c]}
    becomes = {ord(c): theirs[c] for c in points if theirs[c] != _lowered(composed[c]) and not c.isspace()}
    for c in points:
        if 0 < unicodedata.combining(c) < 240 and nfc.normalize_str("ͅ" + c) != unicodedata.normalize("NFC", "ͅ" + c):
            inert.add(c)
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            pair = "".join(chr(int(p, 16)) for p in parts)
            if nfc.normalize_str(pair) != unicodedata.normalize("NFC", pair):
                inert.update(c, pair)
    added, taken = {}, {}
    for name, pattern in _CLASSES.items():
        own = "".join(regex.findall(pattern, "".join(points)))
        other = "".join(regex.findall(pattern.replace("p", "P").replace("s", "S"), "".join(points)))
        of = Split(Regex(f"[{pattern}]+"), "removed")
        taken[name] = "".join(s for s, _ in of.pre_tokenize_str(own))
        added[name] = "".join(s for s, _ in Split(Regex(f"[^{pattern}]+"), "removed").pre_tokenize_str(other))
    return Differences(becomes, "".join(sorted(inert)), added, taken)


def _set_of(chars: str) -> str:
    """A character set's inside: runs of code points as ranges."""
    out, run = [], []
    for c in [*sorted(map(ord, chars)), None]:
        if run and c != run[-1] + 1:
            out.append(f"\\U{run[0]:08x}-\\U{run[-1]:08x}")
            run = []
        if c is not None:
            run.append(c)
    return "".join(out)


class Splitter:
    """Normalised words of a text, by the vocabulary's pattern."""

    def __init__(self, unicode: Differences):
        self.becomes = unicode.becomes
        self.inert = regex.compile(f"([{_set_of(unicode.inert)}])") if unicode.inert else None
        self.strange = frozenset(map(chr, self.becomes)).union(unicode.inert, *unicode.added.values(), *unicode.taken.values())
        #: Fixed value: the vocabulary's pre-split pattern, clitics behind what can't begin one.
        pattern = "{L}+|{N}|'(?:s|t|re|ve|m|ll|d)|[^{s}{L}{N}]+"
        self.ascii = re.compile(r"[a-z]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\x20\x09-\x0Da-z0-9]+")
        self.usual = regex.compile(pattern.format(**_CLASSES))
        kind = {}
        for name, of in _CLASSES.items():
            one = f"[{of}--[{_set_of(unicode.taken[name])}]]" if unicode.taken.get(name) else f"[{of}]"
            kind[name] = f"[{one}||[{_set_of(unicode.added[name])}]]" if unicode.added.get(name) else one
        self.any = regex.compile("(?V1)" + pattern.format(**kind))

    def composed(self, text: str) -> str:
        """NFC, but for inert characters: they stay apart from what is on both sides."""
        if self.inert is None:
            return unicodedata.normalize("NFC", text)
        return "".join(unicodedata.normalize("NFC", x) if i % 2 == 0 else x for i, x in enumerate(self.inert.split(text)))

    def __call__(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii.findall(text.lower())
        if self.strange.isdisjoint(text):
            return self.usual.findall(_lowered(unicodedata.normalize("NFC", text)))
        return self.any.findall(_lowered(self.composed(text).translate(self.becomes)))


# --- the automaton


class State(dict):
    """A state over symbols: the next state by symbol, computed when it is first asked for."""

    __slots__ = ("owner", "node", "before", "token")

    def __init__(self, owner: Automaton, node: int, before: list[int]):
        self.owner, self.node, self.before = owner, node, before
        self.token = before[-1]

    def __missing__(self, symbol: int) -> State:
        found = self[symbol] = self.owner.step(self, symbol)
        return found


class Words(dict):
    """Ids by word; a missing word is encoded."""

    def __init__(self, word):
        self.word = word

    def __missing__(self, text: str) -> tuple[int, ...]:
        ids = self.word(text)
        if len(text) <= LONGEST_CACHED:
            if len(self) >= MOST_CACHED:
                self.clear()
            self[text] = ids
        return ids


class Automaton:
    """Compiled merges.  ``tokens``: label by id; ``merges``: pairs of labels in order."""

    def __init__(self, tokens: list[str], merges: list[tuple[str, str]], suffix: str, special: dict[str, int], unicode: Differences = Differences()):
        self.labels, self.special = tokens, special
        ids = {t: i for i, t in enumerate(tokens)}
        #: The tokens of a token's right and left edge, each with the time when it went into the next
        #: larger one; those of the right edge shifted.
        self.right = [((i << 24, _NEVER),) for i in range(len(tokens))]
        self.left = [((i, _NEVER),) for i in range(len(tokens))]
        self.gone: dict[int, int] = {}
        reached = [t not in special for t in tokens]
        for time, (x, y) in enumerate(merges):
            a, b, c = ids[x], ids[y], ids[x + y]
            # The gadget: c exists only where the arc b is still there behind a.
            reached[c] = reached[a] and reached[b] and self.arc(a, b)
            self.gone.setdefault(a << 24 | b, time)
            self.left[c] = ((c, _NEVER), (a, time), *self.left[a][1:])
            self.right[c] = ((c << 24, _NEVER), (b << 24, time), *self.right[b][1:])
        self.mark = _LAST if suffix else 0
        self._join_labels([i for i, r in enumerate(reached) if r], suffix)
        self.restart()
        self.words = Words(self.word)
        self.split = Splitter(unicode)
        self._special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def arc(self, a: int, b: int) -> bool:
        """Whether the state behind ``a`` has the arc ``b``: not if a merge of tokens at their edges
        came before these went into larger ones.  Of two merges of one rule the left one comes first,
        hence < on one side and <= on the other."""
        gone, ahead = self.gone, self.left[b]
        for u, until_u in self.right[a]:
            for v, until_v in ahead:
                at = gone.get(u | v)
                if at is not None and at < until_u and at <= until_v:
                    return False
        return True

    def _join_labels(self, plain: list[int], suffix: str) -> None:
        """The trie of the labels' symbols, with failure links."""
        byte = {c: b for b, c in enumerate(byte_letters())}
        self.next: list[dict[int, int]] = [{}]
        self.at: list[int] = [-1]  # the token that a node's string is
        self.size = [0] * len(self.labels)
        for i in plain:
            label = self.labels[i]
            ends = bool(suffix) and label.endswith(suffix)
            symbols = [byte[c] for c in (label.removesuffix(suffix) if ends else label)]
            symbols[-1] += self.mark * ends
            node = 0
            for s in symbols:
                child = self.next[node].get(s)
                if child is None:
                    child = self.next[node][s] = len(self.next)
                    self.next.append({})
                    self.at.append(-1)
                node = child
            self.at[node], self.size[i] = i, len(symbols)
        self.fail = [0] * len(self.next)
        queue = deque(self.next[0].values())
        while queue:
            node = queue.popleft()
            for s, child in self.next[node].items():
                queue.append(child)
                back = self.fail[node]
                while back and s not in self.next[back]:
                    back = self.fail[back]
                self.fail[child] = self.next[back].get(s, 0)
        # Strings that no label goes on from needn't be remembered.
        queue.extend(self.next[0].values())
        while queue:
            node = queue.popleft()
            queue.extend(self.next[node].values())
            back = self.fail[node]
            self.fail[node] = back if self.next[back] else self.fail[back]
        #: The children of each node on a node's failure path, the node itself first.
        self.paths: dict[int, tuple[dict[int, int], ...]] = {0: (self.next[0],)}

    def restart(self) -> None:
        """An empty transition table."""
        self.start = State(self, 0, [-1])
        self.states = {(0, -1): self.start}

    def step(self, state: State, symbol: int) -> State:
        """The transition: ``before`` of a state has the token before each node's string on the
        failure path, longest string first and the empty one last."""
        children, at = self.next, self.at
        node, token = 0, -1
        before = []
        for there, last in zip(self._path(state.node), state.before, strict=True):
            child = there.get(symbol)
            if child is None:
                continue
            if children[child]:
                node = node or child
                before.append(last)
            if token < 0 <= at[child] and (last < 0 or self.arc(last, at[child])):
                token = at[child]
        if token < 0:
            raise ValueError(f"no arc for symbol {symbol}")
        before.append(token)
        key = (node, *before)
        found = self.states.get(key)
        if found is None:
            if len(self.states) >= MOST_STATES:
                self.restart()
                state.clear()
            found = self.states[key] = State(self, node, before)
        return found

    def _path(self, node: int) -> tuple[dict[int, int], ...]:
        found = self.paths.get(node)
        if found is None:
            found = self.paths[node] = (self.next[node], *self._path(self.fail[node]))
        return found

    def word(self, text: str) -> tuple[int, ...]:
        """The ids of one pre-split word."""
        data = text.encode()
        state, emitted = self.start, []
        for b in data[:-1]:
            state = state[b]
            emitted.append(state.token)
        emitted.append(state[data[-1] + self.mark].token)
        size, at, out = self.size, len(data), []
        while at:
            token = emitted[at - 1]
            out.append(token)
            at -= size[token]
        return tuple(out[::-1])

    def pieces(self, text: str) -> list[str | int]:
        """Words of a text after normalisation; special tokens as their ids."""
        out: list[str | int] = []
        at = 0
        for m in self._special.finditer(text):
            out += self.split(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self.split(text[at:])

    def encode(self, text: str) -> list[int]:
        ids_of = self.words.__getitem__
        if self._special is None or "<|" not in text or not self._special.search(text):
            return list(chain.from_iterable(map(ids_of, self.split(text))))
        return list(chain.from_iterable((p,) if isinstance(p, int) else ids_of(p) for p in self.pieces(text)))

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.labels.__getitem__, ids))


def load(path: str) -> tuple[list[str], list[tuple[str, str]], str, dict[str, int]]:
    with open(path, "rb") as f:
        return tables(f.read())


def tables(file: bytes) -> tuple[list[str], list[tuple[str, str]], str, dict[str, int]]:
    """Labels, merges, the mark of a word's end and special tokens of a tokenizer's file."""
    parsed = json.loads(file)
    special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
    vocab = parsed["model"]["vocab"] | special
    tokens = sorted(vocab, key=vocab.__getitem__)
    return tokens, [tuple(m) for m in parsed["model"]["merges"]], parsed["model"]["end_of_word_suffix"] or "", special


def digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


@lru_cache(maxsize=4)
def _shipped(path: str, key: str) -> tuple[bytes, Differences]:
    """What an automaton is compiled from, the file as it is; ``key``: its digest."""
    with open(path, "rb") as f:
        return f.read(), unicode_differences(path)


def _tables(path: str, key: str) -> tuple:
    file, differences = _shipped(path, key)
    return *tables(file), differences


_held: dict[str, Automaton] = {}


def _compiled(key: str, broadcast: object) -> Automaton:
    """The worker's one automaton, under its file's digest: later queries with that file use it.  The
    tables are read from the file's bytes here and go once the automaton stands."""
    if key not in _held:
        _held.clear()
        release_memory()
        file, differences = broadcast.value
        _held[key] = Automaton(*tables(file), differences)
        release_memory()
    return _held[key]


def shared(spark: SparkSession, path: str | None = None):
    """A function for tasks that gives the automaton, compiled once in each worker.  What is
    broadcast is the vocabulary's file, whose size is fixed."""
    path = path or default_path()
    small_batches(spark)
    key = digest(path)
    shipped = spark.sparkContext.broadcast(_shipped(path, key))
    return lambda: _compiled(key, shipped)


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded) of each row: the operator's own output."""
    get = shared(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = get()
        for batch in chunks(batches):
            ids = [bpe.encode(t.decode()) for t in batch.column("text").to_pylist()]
            decoded = pa.array([bpe.decode(x) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), decoded], ["doc_id", "ids", "decoded"])

    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    return df.mapInArrow(freed(run), "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256); ids and labels stay in the task."""
    get = shared(docs.sparkSession, path)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = get()
        decimal = [str(i) for i in range(len(bpe.labels))]
        for batch in chunks(batches, most_bytes=1 << 21):
            rows = []
            for text in batch.column("text").to_pylist():
                ids = bpe.encode(text.decode())
                rows.append((len(ids), sha(" ".join(map(decimal.__getitem__, ids))), sha(bpe.decode(ids))))
            kinds = (pa.int64(), pa.string(), pa.string())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    return df.mapInArrow(freed(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: token counts and digests of each row."""
    return digests(docs)
