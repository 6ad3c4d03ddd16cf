"""The tokenization automaton against the tokenizer library: odd characters, long words, digests."""

import collections
import hashlib
import random
import unicodedata

import pytest
from tokenizers import Tokenizer

from loglathe.llm import bpe

from test_operators import SCHEMA, corpus

PATH = bpe.default_path()


@pytest.fixture(scope="module")
def own():
    return bpe.Automaton(*bpe._tables(PATH, "test"))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def same(own, library, texts):
    return [own.encode(t) for t in texts] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_every_assigned_character(own, library):
    chars = [c for c in map(chr, range(0x110000)) if unicodedata.category(c) not in ("Cn", "Cs", "Co")]
    assert same(own, library, ["a" + "b ".join(chars[i : i + 200]) for i in range(0, len(chars), 200)])


def test_random_marks_and_characters(own, library):
    r = random.Random(11)
    chars = [c for c in map(chr, range(0x110000)) if unicodedata.category(c) not in ("Cn", "Cs")]
    marks = [c for c in chars if unicodedata.combining(c)] + list("aeoAEOΣİ")
    assert same(own, library, ["".join(r.choices(chars, k=12)) for _ in range(3000)])
    assert same(own, library, ["".join(r.choices(marks, k=6)) for _ in range(3000)])


@pytest.mark.parametrize("alphabet", ["a", "ab", "abcdefghijklmnopqrstuvwxyz", "日本語文字列長"])
def test_long_words(own, library, alphabet):
    word = "".join(random.Random(4).choices(alphabet, k=200_000))
    assert same(own, library, [word])


def test_a_full_table_starts_anew(library, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_STATES", 50)
    own = bpe.Automaton(*bpe._tables(PATH, "test"))
    r = random.Random(5)
    assert same(own, library, ["".join(r.choices("abcdeilnorst", k=40)) for _ in range(200)])
    assert len(own.states) <= 50


def test_arcs_are_the_merges_own(own, library):
    """The pairs of the automaton's arcs stay apart when the library encodes them, others don't."""
    r = random.Random(6)
    plain = [i for i, t in enumerate(own.labels) if t.isalpha() and t.islower() and t.isascii() and own.size[i]]
    ends = [i for i, t in enumerate(own.labels) if t.endswith("</w>") and t[:-4].isalpha() and t.islower() and t.isascii() and own.size[i]]
    for _ in range(3000):
        a, b = r.choice(plain), r.choice(ends)
        word = own.labels[a] + own.labels[b].removesuffix("</w>")
        assert own.arc(a, b) == (library.encode(word, add_special_tokens=False).ids == [a, b])


def test_digests_of_the_query(spark, library):
    rows = corpus(seed=8, n=40) + [(901, "x" * 30_000, None, None, 0, "clash", 1), (902, "𐰇 ࡰ 𪛞 Ꟊ", None, None, 0, "clash", 1)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = collections.Counter()
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))] += 1
    got = bpe.digests(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert collections.Counter(map(tuple, got.collect())) == want
