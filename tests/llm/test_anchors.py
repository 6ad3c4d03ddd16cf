"""Substring deduplication's tasks one after another in this process, so that their limits can be made small
(workers of Spark import the module afresh), against brute force."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from loglathe.llm import substring

from test_operators import corpus, ordered


def batches(rows, names, size=7):
    """Arrow batches of a few rows, as a shuffle may cut them."""
    for i in range(0, len(rows), size):
        yield pa.RecordBatch.from_pylist([{c: r[c] for c in names} for r in rows[i : i + size]])


def shuffled(rows, key, seed):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[key(r)].append(r)
    for g in groups.values():
        random.Random(seed).shuffle(g)
    return groups.values()


def listed(found):
    return [row for batch in found for row in batch.to_pylist()]


def removed(docs, tasks=4, buckets=3, shards=5):
    """Places (k1, start) of the removed windows; ``docs``: (k1, text)."""
    rows = [{"kd": k * 7 - 50, "k1": k, "k2": 0, "copies": None, "text": t} for k, t in docs]
    dealt = [r for t in range(tasks) for r in listed(substring._find_anchors(buckets)(batches(rows[t::tasks], ["kd", "copies", "text"])))]
    names = ["bucket", "kds", "counts", "hashes", "starts", "shapes", "pieces"]
    found = [r for g in shuffled(dealt, lambda r: r["bucket"], 1) for r in listed(substring._recurring(batches(g, names, 2)))]
    by_kd = collections.defaultdict(list)
    for r in found:
        by_kd[r["kd"]].append(r)
    sent = listed(substring._send_texts(shards)([pa.RecordBatch.from_pylist([{**r, "found": by_kd.get(r["kd"])} for r in rows])]))
    names = [x.split()[0] for x in substring._TEXTS.split(", ")]
    windows = [r for g in shuffled(sent, lambda r: r["shard"], 2) for r in listed(substring._search_shard(batches(g, names)))]
    names = [x.split()[0] for x in substring._FOUND.split(", ")]
    last = [r for g in shuffled(windows, lambda r: r["route"] % 3, 3) for r in listed(substring._resolve([pa.RecordBatch.from_pylist([{c: r[c] for c in names} for r in g])]))]
    return {(r["k1"], int(a)) for r in last for a in np.frombuffer(r["starts"], np.uint32)}, found


def plainly(docs):
    seen, out = set(), set()
    for k, t in sorted(docs):
        w = t.split()
        for a in range(len(w) - 19):
            key = tuple(w[a : a + 20])
            if key in seen:
                out.add((k, a))
            seen.add(key)
    return out


def texts(seed):
    docs = [(i, (t or "").encode()) for i, (_, t) in enumerate(ordered(corpus(seed, 90)))]
    return [d for d in docs if len(d[1]) < 20_000] + [(500 + i, b"same word " * 40) for i in range(3)]


@pytest.mark.parametrize(("hot", "flush", "often", "bucket"), [(4096, 500_000, 64, 10**6), (3, 500_000, 64, 10**6), (3, 50, 2, 10**6), (2, 400, 5, 10**6), (3, 10**6, 10**6, 40), (3, 10**6, 3, 20), (2, 300, 4, 30)])
def test_any_dealing_gives_the_same(monkeypatch, hot, flush, often, bucket):
    for name, value in (("HOT", hot), ("_FLUSH", flush), ("OFTEN", often), ("BUCKET_ANCHORS", bucket)):
        monkeypatch.setattr(substring, name, value)
    for seed in (3, 4):
        docs = texts(seed)
        got, found = removed(docs)
        assert got == plainly(docs)
        assert hot == 4096 or any(r["dealt"] for r in found)


def test_no_task_holds_an_anchor():
    """One passage in every document: buckets are told of its anchors, and hold none of their places."""
    r = random.Random(2)
    passage = [b"p%d" % i for i in range(40)]
    docs = [(i, b" ".join([b"%d" % r.randrange(10**6) for _ in range(25)] + passage)) for i in range(3000)]
    rows = listed(substring._find_anchors(4)(batches([{"kd": k, "copies": None, "text": t} for k, t in docs], ["kd", "copies", "text"], 500)))
    common = {int(h) for h in substring.anchors(passage)[0]}
    hashes = [int(h) for row in rows for h in np.frombuffer(row["hashes"], np.uint64)]
    assert common and all(hashes.count(h) == 1 for h in common)
    assert sum(len(row["pieces"]) for row in rows) // 4 >= 3000 * len(common)
    got, found = removed(docs)
    assert got == plainly(docs)
    assert sum(row["dealt"] for row in found) >= 3000 * len(common)


def test_bucket_stays_small(monkeypatch):
    """Moderately frequent anchors from many tasks: a bucket hands on what it needn't hold."""
    monkeypatch.setattr(substring, "BUCKET_ANCHORS", 100)
    hashes = np.repeat(np.arange(5, dtype=np.uint64), 40)
    one = lambda t: {"bucket": 0, "kds": np.arange(t, t + 200).tobytes(), "counts": np.ones(200, np.uint32).tobytes(), "hashes": hashes.tobytes(), "starts": np.zeros(200, np.uint32).tobytes(), "shapes": np.zeros(200, np.uint8).tobytes(), "pieces": b""}
    seen = []
    reduced = substring._reduced
    monkeypatch.setattr(substring, "_reduced", lambda held: (seen.append(sum(len(x) for x, *_ in held)), reduced(held))[1])
    out = listed(substring._recurring(batches([one(t * 200) for t in range(50)], list(one(0)), 3)))
    assert len(out) == 50 * 200 and all(r["dealt"] == 1 for r in out)
    assert len(seen) > 20 and max(seen) <= 405
