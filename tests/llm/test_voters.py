"""The toxicity score: its voters, and its label model against a plain version."""

import itertools
import math
import random

import numpy as np
import pytest

from loglathe.llm import toxicity


def test_every_voter_that_passes_is_kept(spark):
    words = [a + b + c for a in "abcdefghi" for b in "jklmnopqr" for c in "stuvwxyz"]
    assert len(words) > 500
    rows = [(w + " plain", 1) for w in words for _ in range(9)] + [("plain text", 0)] * 8000 + [(words[0] + " plain", 0)] * 9
    sample = spark.createDataFrame(rows, "text string, toxic int").selectExpr("CAST(text AS BINARY) AS text", "toxic").repartition(4)
    assert toxicity.mine(sample) == sorted(w.encode() for w in words[1:])


def plain_model(rows, parent, rounds):
    """Expectation maximisation over full tables of votes, one factor a source."""
    n = len(parent)
    given = lambda votes, i: int(parent[i] in votes)
    weights, rates, prior = [t if t is not None else None for _, t, _ in rows], None, None
    for step in range(rounds):
        used = [(set(v), w, t) for (v, _, t), w in zip(rows, weights, strict=True) if w is not None]
        total = [sum((1 - w) * t for _, w, t in used), sum(w * t for _, w, t in used)]
        rates = {}
        for i, a, y in itertools.product(range(n), (0, 1), (0, 1)):
            mass = lambda keep: sum((w if y else 1 - w) * t for v, w, t in used if keep(v))  # noqa: B023, E731
            usual = (mass(lambda v: i in v) + (0.1 if y else 0.01)) / (total[y] + 1)
            texts = mass(lambda v: given(v, i) == a)
            rates[i, a, y] = min(max((mass(lambda v: i in v and given(v, i) == a) + usual) / (texts + 1), 1e-7), 0.999)
        prior = math.log((total[1] + 1) / (total[0] + 1))
        odds = []
        for v, *_ in rows:
            z = prior
            for i in range(n):
                r = [rates[i, given(set(v), i), y] for y in (0, 1)]
                z += math.log(r[1] / r[0]) if i in v else math.log((1 - r[1]) / (1 - r[0]))
            odds.append(1 / (1 + math.exp(-z)))
        if step < rounds - 1:
            weights = [t if t is not None else o for (_, t, _), o in zip(rows, odds, strict=True)]
    return odds


def test_label_model_against_a_plain_version(spark):
    r, parent = random.Random(4), [-1, 0, 1, -1, 0]
    found = {}
    for _ in range(400):
        toxic = r.random() < 0.3
        v = tuple(i for i in range(5) if r.random() < (0.5 if toxic else 0.05) * (1 + (parent[i] == 0)))
        key = v, r.choice([None, int(toxic)])
        found[key] = found.get(key, 0) + 1
    rows = [(list(v), t, c) for (v, t), c in found.items()]
    table = spark.createDataFrame(rows, "v array<int>, toxic int, times long").repartition(3)
    model = toxicity.label_model(table, parent)
    assert [model.posterior(set(v)) for v, *_ in rows] == pytest.approx(plain_model(rows, parent, toxicity.ROUNDS), abs=1e-5)
    assert toxicity.label_model(table.limit(0), parent).posterior(set()) <= 0.5


def test_voters_that_depend_count_once():
    votes, labels = np.array([[1, 1, 0], [1, 1, 0], [0, 0, 1], [0, 0, 0], [1, 0, 1]], float), np.array([1, 0, 1, 0, 1])
    times = np.array([60.0, 30, 40, 500, 20])
    parent = toxicity.dependencies(votes, labels, times)
    assert parent[0] == -1 and parent[1] == 0
    rows = [(np.flatnonzero(v).tolist(), int(y), int(t)) for v, y, t in zip(votes, labels, times, strict=True)]

    def posterior(parent):
        counts = toxicity.tally(rows, None, parent)
        on = np.array([[[counts[i, a, y] for y in (0, 1)] for a in (0, 1)] for i in range(3)], float) / 1e6
        return toxicity.estimate(parent, on, np.array([counts[-1, 0, y] for y in (0, 1)]) / 1e6).posterior({0, 1})

    assert abs(posterior(parent) - 60 / 90) < abs(posterior([-1, -1, -1]) - 60 / 90)


def test_scores_of_odd_rows(spark):
    r = random.Random(8)
    rows = [(i, " ".join(r.choices(["w%d" % k for k in range(60)], k=20)) + (" vile" if i % 6 == 0 else "")) for i in range(600)]
    rows += [(7000, None), (7001, ""), (7002, "w1 " * 400_000 + "vile"), (0, rows[0][1]), (None, "a vile text"), (None, None)]
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, v string, toxic int, held_out int").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(600)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    out = toxicity.scored(docs, toxicity.train(docs, labels)).collect()
    assert len(out) == len(rows)
    assert sorted(r.predicted for r in out) == sorted(int("vile" in (t or "")) for _, t in rows)
    assert len({r.score for r in out if r.doc_id == 0}) == 1
    assert toxicity.scored(docs.limit(0), toxicity.train(docs.limit(0), labels)).count() == 0
