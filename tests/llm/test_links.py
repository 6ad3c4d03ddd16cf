"""Numbers of links of the Jaccard join against all pairs."""

import random

from loglathe.llm import jaccard

from test_operators import SCHEMA, corpus, ordered, shingle_set


def table(spark, texts):
    return [(i, t, None, None, 0, "clash", 7) for i, t in enumerate(texts)]


def all_links(rows):
    d = ordered(rows)
    sets = [shingle_set(t) for _, t in d]
    count = dict.fromkeys(d, 0)
    for i in range(len(d)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                count[d[i]] += 1
                count[d[j]] += 1
    return sorted((-1 if i is None else i, count[2**63 - 1 if i is None else i, t]) for i, t, *_ in rows)


def check(spark, rows):
    got = jaccard.counted(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_links) for r in got) == all_links(rows)


def near_copies(n):
    """Near copies of one text, of different lengths, some exact or with equal sets."""
    r = random.Random(3)
    base = ["b%d" % i for i in range(150)]
    texts = []
    for i in range(n):
        w = base[: r.choice([150, 150, 130, 118])] + ["e%d" % i] * r.randrange(2)
        w[r.randrange(len(w))] = "x%d" % i
        texts.append(" ".join(w))
    return texts + texts[:5] + [t.upper() for t in texts[3:9]] + [" copied often without any near copy "] * 4


def test_every_link_counts(spark):
    check(spark, corpus())
    check(spark, table(spark, near_copies(60)))


def test_large_component_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 7)
    check(spark, table(spark, near_copies(60)))
