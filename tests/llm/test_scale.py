"""Hot keys and long lists."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loglathe.llm import common, jaccard, substring

from test_operators import SCHEMA, corpus, test_jaccard_against_brute_force, test_substring_against_brute_force


@pytest.fixture(scope="module")
def rows():
    return corpus(seed=5, n=150)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_salted_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    left = spark.createDataFrame([(i % 3 if i < 60 else 50 + i, i) for i in range(80)], "k long, x long")
    right = spark.createDataFrame([(i, f"r{i}") for i in range(70)], "k long, y string")
    got = common.joined_by(left, right, ["k"], ["x"], "test")
    assert sorted(map(tuple, got.select("k", "x", "y").collect())) == sorted(map(tuple, left.join(right, "k").select("k", "x", "y").collect()))


def test_every_join_salted_and_every_list_long(docs, rows, empty, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 1)
    monkeypatch.setattr(jaccard, "LONG", 1)
    monkeypatch.setattr(jaccard, "LIST_BLOCK", 2)
    test_jaccard_against_brute_force(docs, rows, empty)


def test_substring_with_salted_copies(docs, rows, empty, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 1)
    test_substring_against_brute_force(docs, rows, empty)


def test_members_of_groups_are_expanded(spark):
    """Sets with equal prefixes and sizes that don't all link with their group's first, and links
    between members of two groups that are not the groups' first."""
    r = random.Random(1)
    words = ["w%d" % i for i in range(60)]
    texts = [" ".join(w if r.random() > 0.06 else r.choice(words) for w in words) for _ in range(80)] * 2
    d = spark.createDataFrame([(i, t, None, None, 0, "c", 1) for i, t in enumerate(texts)], SCHEMA)
    test_jaccard_against_brute_force(d, [(i, t, None, None, 0, "c", 1) for i, t in enumerate(texts)], d.limit(0))


def postings(n, label, place):
    m = len(n)
    columns = [np.full(m, 7, np.uint64), place.astype(np.uint32), n.astype(np.uint32), np.arange(m, dtype=np.int64), label.astype(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], ["tokens", "places", "ns", "nodes", "labels"])


def all_pairs(batch):
    found = set()
    for b in jaccard._across(iter([batch])):
        direct = b.filter(pa.compute.is_valid(b.column("a")))
        found |= set(zip(direct.column("a").to_pylist(), direct.column("b").to_pylist(), strict=True))
        for met in jaccard._blocks_met(iter([b.filter(pa.compute.is_null(b.column("a")))])):
            found |= set(zip(met.column("a").to_pylist(), met.column("b").to_pylist(), strict=True))
    return found


def test_a_long_list_in_blocks_has_all_pairs(monkeypatch):
    r = np.random.default_rng(2)
    batch = postings(r.integers(5, 60, 300), r.integers(0, 5, 300), r.integers(0, 4, 300))
    plain = all_pairs(batch)
    monkeypatch.setattr(jaccard, "LONG", 20)
    monkeypatch.setattr(jaccard, "LIST_BLOCK", 13)
    assert all_pairs(batch) == plain and len(plain) > 1000


def test_a_long_list_leaves_its_task_in_small_pieces():
    batch = postings(np.full(20_000, 50), np.arange(20_000), np.zeros(20_000))
    blocks = list(jaccard._across(iter([batch])))
    assert sum(b.num_rows for b in blocks) == 55 and max(b.nbytes for b in blocks) < 16 << 20
    one = next(jaccard._blocks_met(iter([blocks[0].slice(0, 1)])))
    assert one.num_rows <= 50_000


def test_search_in_the_automaton():
    words = [b"w%d" % i for i in range(30)]
    texts = [((1, 0, 0), 5, words[:24]), ((2, 0, 3), 2, words[1:22]), ((1, 0, 0), 5, words[:24]), ((3, 0, 0), 1, words[9:29])]
    removed, first = substring.search(texts)
    assert sorted(removed) == [(2, 0, 3), (2, 0, 4)] and not first
    removed, first = substring.search(texts, every=True)
    assert sorted(removed) == [(2, 0, 3), (2, 0, 4)] and collections.Counter(p for p, _ in first.values()) == {(1, 0, i): 1 for i in range(5)} | {(3, 0, 0): 1}
