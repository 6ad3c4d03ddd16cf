"""Line deduplication against plain counts, and its perfect hash."""

import collections
import random

import numpy as np
import pytest
from loglathe.llm import linededup

SCHEMA = "doc_id long, text string, shard int, _x string, k1 long"
LICENSE = "Permission is hereby granted, free of charge, to ANY person"


def corpus(seed=4, n=150):
    r = random.Random(seed)
    often = [LICENSE, LICENSE.lower(), "  \t" + LICENSE + " \r", "é" * 40, "é" * 39, "é" * 160 + "x", "short line", *("line %d " % i * 6 for i in range(12))]
    texts = ["\n".join(r.choice(often) if r.random() < 0.6 else "%032x%032x" % (r.getrandbits(128), i) for _ in range(r.randrange(1, 9))) for i in range(n)]
    texts += [None, "", "\n", "\n\n" + LICENSE + "\n", "x" * 100_000, "y" * 50_000 + "\n" + LICENSE]
    rows = [(i, t, 1, "clash", 7) for i, t in enumerate(texts)]
    return rows + rows[:9] + [(5, LICENSE + "\nother text", 1, "c", 7), (None, LICENSE, 1, "c", 7), (None, LICENSE + "\n" + often[7], 1, "c", 7)]


def keys(text):
    lines = (text or "").encode().split(b"\n")
    return lines, [x.strip(b" \t\n\x0b\x0c\r").lower().decode() for x in lines]


def plain(rows):
    held = collections.defaultdict(set)
    for i, t, *_ in rows:
        for k in keys(t)[1]:
            if len(k) >= 40:
                held[k].add((2**63 - 1 if i is None else i, t))
    last = {k: max(i for i, _ in v) for k, v in held.items() if len(v) >= 5}
    out = collections.Counter()
    for i, t, *_ in rows:
        lines, ks = keys(t)
        stay = [x for x, k in zip(lines, ks, strict=True) if k not in last or (2**63 - 1 if i is None else i) >= last[k]]
        out[i, b"\n".join(stay).decode(), len(lines), len(lines) - len(stay)] += 1
    return out


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def result(docs):
    found = linededup.deduplicated(docs)
    assert found.columns == [*docs.columns, "_n_lines", "_n_dropped"]
    return collections.Counter((r.doc_id, r.text or "", r._n_lines, r._n_dropped) for r in found.collect())


def test_against_plain_counts(docs, rows):
    want = plain(rows)
    assert sum(n * d for (_, _, _, d), n in want.items()) > 200
    assert result(docs) == want
    assert result(docs.limit(0)) == {}


def test_many_shards_in_many_parts(docs, rows, monkeypatch):
    monkeypatch.setattr(linededup, "SHARD_LINES", 50)
    monkeypatch.setattr(linededup, "PART_POSTINGS", 3)
    assert result(docs) == plain(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 50_000])
def test_perfect_hash(n):
    found = np.unique(np.random.default_rng(n).integers(0, 2**64, n, np.uint64))
    phf = linededup.PerfectHash.of(found)
    assert sorted(phf.numbers(found).tolist()) == list(range(len(found)))
    assert len(phf.words) * 64 <= 5 * len(found) + 64 * max(1, len(phf.sizes))  # about four bits a key
    others = np.random.default_rng(99).integers(0, 2**64, 2000, np.uint64)
    assert phf.numbers(others).max(initial=-1) < max(1, len(found))


def test_strangers_are_refused_by_their_fingerprints():
    h = np.unique(np.random.default_rng(1).integers(0, 2**64, 5000, np.uint64))
    k1, five = np.repeat(np.arange(5), len(h)), np.tile(h, 5)
    table = linededup._by_shard(np.zeros(len(five), np.int64), [five, k1, np.zeros(len(five), np.int64)])
    import pyarrow as pa

    arrays = linededup.Arrays(linededup._index(pa.Table.from_batches([table])).to_pylist()[0])
    assert arrays.drops(h, np.full(len(h), 3)).all() and not arrays.drops(h, np.full(len(h), 4)).any()
    strangers = np.random.default_rng(2).integers(0, 2**64, 100_000, np.uint64)
    assert arrays.drops(strangers, np.zeros(len(strangers), np.int64)).sum() <= 2


def test_summaries_of_a_hot_line_stay_small():
    n = 20_000
    one = linededup._by_shard(np.zeros(n, np.int64), [np.full(n, 7, np.uint64), np.arange(n), np.zeros(n, np.int64)])
    (out,) = linededup._summaries(iter([one]))
    assert out.column("n").to_pylist() == [linededup.LEAST_DOCS]
    assert np.frombuffer(out.column("k1s")[0].as_py(), np.int64).max() == n - 1
