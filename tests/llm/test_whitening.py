"""Whitening against numpy's eigensolver and exact sums."""

import math
import random

import numpy as np
import pytest

from flowdetect.llm import whitening as wh

ROWS = "vec_id long, embedding array<double>, N string"


def plain(vectors, k=16):
    dims = max(map(len, vectors))
    x = [[math.floor(64 * c) + 1_000_000 for c in v] + [1_000_000] * (dims - len(v)) for v in vectors]
    fit = sorted({tuple(r) for r in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[(n * e - s) / n for e, s in zip(r, sums)] for r in fit])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    return n, [sum((n * e - s) ** 2 for e, s in zip(r, sums)) for r in x], values[::-1][:k], vectors[:, ::-1][:, :k], [[(n * e - s) / n for e, s in zip(r, sums)] for r in x], values.sum()


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 20)) @ np.diag(np.linspace(3, 0.5, 20))
    vectors = [list(map(float, v)) for v in base] + [list(map(float, base[0]))] * 150 + [[0.5, -0.5], [0.5, -0.5] + [0.0] * 18]
    rows = [(i if i % 9 else None, v, "z") for i, v in enumerate(vectors)]
    bad = [(1, None, "z"), (2, [1.0, None] * 10, "z"), (3, [math.nan] * 20, "z"), (4, [-math.inf] * 20, "z")]
    got = wh.whiten(spark.createDataFrame(rows + bad, ROWS).selectExpr("*", "7 AS `_x`", "8 AS `p 0`", "monotonically_increasing_id() AS at"))
    assert got.columns == ["vec_id", "embedding", "_x", "p 0", "at", "n", "deviation", "whitened", "explained", "identity_error"]
    held = sorted(got.collect(), key=lambda r: r["at"])
    n, deviation, values, basis, centred, trace = plain(vectors)
    assert len(held) == len(rows) and {r.n for r in held} == {n} and n == 301
    assert [r.deviation for r in held] == deviation
    assert max(r.identity_error for r in held) < 1e-9
    assert np.allclose(held[0].explained, values / trace, rtol=1e-10, atol=0)
    w, want = np.array([r.whitened for r in held]), np.array(centred) @ basis / np.sqrt(values)
    sign = np.sign((w * want).sum(axis=0))
    assert np.abs(w - want * sign).max() < 1e-7
    flat = wh.by_component(got).collect()
    assert len(flat) == 16 * len(rows) and {r.component for r in flat} == set(range(1, 17))


@pytest.mark.parametrize("dims,k,most", [(64, 16, None), (200, 16, None), (300, 6, 24), (5, 16, None), (40, 16, None)])
def test_solver_reaches_double_precision(dims, k, most):
    rng = np.random.default_rng(dims)
    q, _ = np.linalg.qr(rng.normal(size=(dims, dims)))
    values = np.sort(60 + rng.random(dims) * 12)[::-1].copy()
    values[:2] += 40
    values[3] = values[4]
    if dims == 40:
        values[7:] = 0
    a = q @ np.diag(values) @ q.T
    calls = []
    got, vectors, size = wh.jacobi_davidson(lambda b: calls.append(b.shape) or a @ b, dims, k, most=most)
    k = min(k, dims)
    assert np.allclose(got, values[:k], rtol=1e-12, atol=1e-10)
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
    near = 100 * wh.EPS * np.sqrt(dims) * got[0]
    assert np.linalg.norm(a @ vectors - vectors * got, axis=0).max() < near and size.max() < near
    assert all(w <= k + wh.GUARD for _, w in calls)


def test_minres_solves_indefinite_systems():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(12, 12))
    a = a + a.T
    b = np.column_stack([rng.normal(size=12), np.zeros(12), a @ np.ones(12)])
    x = wh.minres(lambda v: a @ v, b, 30, 1e-13)
    assert np.abs(a @ x - b).max() < 1e-8 and (x[:, 1] == 0).all()


def test_small_and_far_tables(spark):
    def run(rows):
        return wh.by_component(wh.whiten(spark.createDataFrame([(i, v, "") for i, v in rows], ROWS))).collect()

    assert run([]) == [] and run([(1, None)]) == [] and run([(1, [])]) == []
    assert run([(1, [0.5, 1.0]), (2, [0.5, 1.0])]) == []  # one vector has no variance
    got = run([(1, [1.0, 1.0]), (2, [3.0, 3.0]), (3, [1.0, 1.0])])
    assert {(r.vec_id, r.component, r.n, r.deviation) for r in got} == {(1, 1, 2, 2 * 128**2), (2, 1, 2, 2 * 128**2), (3, 1, 2, 2 * 128**2)}
    assert sorted(round(abs(r.whitened), 9) for r in got) == [1, 1, 1] and {round(r.explained, 9) for r in got} == {1}
    far = run([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [1e14, 2.0])])
    assert {r.deviation for r in far} == {None} and all(math.isfinite(r.whitened) for r in far)
    rng = random.Random(1)
    few = [(i, [rng.gauss(0, 1) for _ in range(30)]) for i in range(5)]
    got = run(few)
    assert len(got) == 5 * 4 and max(r.identity_error for r in got) < 1e-9
