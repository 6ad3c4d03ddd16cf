"""Whitening against a dense solver."""

import collections
import math

import numpy as np
import pytest
from loglathe.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n long, x string"


def vectors(n=300, d=40, seed=5):
    r = np.random.default_rng(seed)
    m = r.standard_normal((n, d)) @ np.diag(np.linspace(1.4, 0.6, d)) @ np.linalg.qr(r.standard_normal((d, d)))[0]
    return [(i, [float(x) for x in v], 1, "clash") for i, v in enumerate(np.float32(m))]


def odd(rows):
    a = rows[0][1]
    return rows + rows[:20] + [(7000, None, 1, ""), (7001, [*a[:-1], math.nan], 1, ""), (7002, [None, *a[1:]], 1, ""), (7003, [math.inf, *a[1:]], 1, ""), (7004, [], 1, ""), (None, a, 1, "")]


def whole(v):
    return [math.floor(256 * float(np.float32(c))) for c in v]


def dense(rows):
    """Expected rows with the components' signs open: id -> (deviation, projections), and e / trace."""
    xs = [(i, whole(v)) for i, v, *_ in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in xs})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[c - t / n for c, t in zip(x, s, strict=True)] for x in fit])
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:4], u[:, ::-1][:, :4]
    out = [(i, sum((n * c - t) ** 2 for c, t in zip(x, s, strict=True)), (np.array(x) - np.array(s) / n) @ u / np.sqrt(e)) for i, x in xs]
    return n, out, e / np.trace(v)


def compare(spark, rows):
    n, want, explained = dense(rows)
    got = whitening.whitened(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == 4 * len(want) and {r.n for r in got} == {n}
    assert collections.Counter((r.vec_id, r.deviation) for r in got if r.component == 1) == collections.Counter((i, d) for i, d, _ in want)
    assert max(r.identity_error for r in got) < 1e-9
    for k in range(4):
        mine = sorted((r.deviation, r.whitened) for r in got if r.component == k + 1)
        theirs = sorted((d, z[k]) for _, d, z in want)
        sign = np.sign(sum(a[1] * b[1] for a, b in zip(mine, theirs, strict=True)))
        assert max(abs(a[1] - sign * b[1]) for a, b in zip(mine, theirs, strict=True)) < 1e-8
        assert [r.explained for r in got if r.component == k + 1] == pytest.approx([explained[k]] * len(want), rel=1e-9)


def test_against_a_dense_solver(spark):
    compare(spark, odd(vectors()))


def test_few_dimensions_are_solved_at_once(spark):
    compare(spark, vectors(50, 6))


def test_fewer_vectors_than_components(spark):
    rows = [(1, [1.0, 2.0, 3.0, 4.0, 5.0], 1, ""), (2, [2.0, 2.0, 3.0, 4.0, 5.0], 1, ""), (3, [2.0, 2.0, 3.0, 4.0, 5.0], 1, "")]
    got = whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.vec_id, r.component, round(abs(r.whitened), 9)) for r in got) == [(1, 1, 1.0), (2, 1, 1.0), (3, 1, 1.0)]
    assert {round(r.explained, 9) for r in got} == {1.0}


def test_lengths_are_fits_of_their_own(spark):
    rows = vectors(30, 5) + [(100 + i, v, 1, "") for i, v, *_ in vectors(20, 7, 6)]
    got = whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    assert collections.Counter((r.vec_id >= 100, r.n) for r in got) == {(False, 30): 120, (True, 20): 80}


def test_nothing_to_fit(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.whitened(empty).collect() == []
    assert whitening.whitened(spark.createDataFrame([(1, [], 1, ""), (2, [5.0, 5.0], 1, ""), (3, [5.0, 5.0], 1, "")], SCHEMA)).collect() == []


def test_huge_entries(spark):
    rows = [(1, [3e38, 1.0], 1, ""), (2, [-3e38, 2.0], 1, ""), (3, [0.0, 3.0], 1, "")]
    got = whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.deviation for r in got if r.vec_id != 3} == {None} and all(math.isfinite(r.whitened) for r in got)


@pytest.mark.parametrize("spectrum", [np.linspace(100, 1, 64), np.ones(64), np.r_[np.full(6, 9.0), np.ones(58)], np.r_[5.0, 4.0, np.zeros(62)], 0.5 ** np.arange(64), np.r_[np.ones(30) + 1e-7 * np.arange(30), np.full(34, 0.999)], np.zeros(64)])
def test_components_of_many_spectra(spectrum):
    u = np.linalg.qr(np.random.default_rng(3).standard_normal((64, 64)))[0]
    v = u @ np.diag(spectrum) @ u.T
    passes = []
    e, q = whitening.leading(lambda b: passes.append(1) or v @ b, 64)
    assert np.allclose(e, np.sort(spectrum)[::-1][:4], rtol=1e-12, atol=1e-12)
    assert np.linalg.norm(v @ q - q * e) <= 1e-10 * max(spectrum.max(), 1e-300) and np.allclose(q.T @ q, np.eye(4))
    assert len(passes) < 300
