"""Hard negatives against a full scan; the heap's order and the bounds."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowdetect.llm import hard_negatives as hn

ROWS = "vec_id long, embedding array<double>, label int, key string, shelf int"


def plain(rows, positives=5, negatives=10):
    fine = [(n, i, [math.floor(256 * x) for x in v], lab) for n, (i, v, lab) in enumerate(rows) if v is not None and lab is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, v, lab in fine:
        if i is None or i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j is None, j or 0, m, jl, j) for m, j, w, jl in fine if m != n)
        for p in [s for s in scored if s[4] == lab][:positives]:
            fit = [s for s in scored if s[4] != lab and 30 * -p[0] <= 100 * -s[0] <= 90 * -p[0]][:negatives]
            out += [(i, p[5], r, s[5], -p[0], -s[0]) for r, s in enumerate(fit, 1)]
    return out


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, "k", 5) for r in rows], ROWS)
    return [tuple(r) for r in hn.mine(df, F.col("id") % 100 == 0, **more).collect()]


def ordered(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("first", [40, 1 << 14])
def test_equal_to_a_full_scan(spark, monkeypatch, first):
    monkeypatch.setattr(hn, "SHELF", 64)
    monkeypatch.setattr(hn, "BLOCK", 3)
    monkeypatch.setattr(hn, "GROW", 3)
    rng = random.Random(1)
    middles = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(20 * i, [m + rng.gauss(0, 0.2) for m in middles[i % 4]], rng.randrange(3)) for i in range(300)]
    rows += [(100 * i, list(rows[0][1]), 0) for i in range(30, 130)]  # a hot vector, repeated ids
    rows += [(None, list(rows[0][1]), 0), (None, list(rows[0][1]), 1), (7, None, 1), (200, [1.0] * 6, None), (300, [math.nan] * 6, 1), (300, [1.0, None] * 3, 1), (400, [math.inf] * 6, 0)]
    rows += [(500, [1.5, -2.0], 1), (600, [0.0] * 6, 2), (700, [-1.0] * 6, 2), (600, [0.0] * 6, 2)]
    got = run(spark, rows, first=first)
    assert ordered(got) == ordered(plain(rows)) and len(got) > 1000


def test_few_rows_and_far_values(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0], 1)]) == []
    assert run(spark, [(0, [], 1), (1, [], 1), (2, [], 2)]) == [(0, 1, 1, 2, 0, 0)]
    got = run(spark, [(0, [1e300, 1e300], 1), (1, [1e300, 1.0], 1), (2, [1e13, 0.0], 2), (3, [1e12, 1.0], 2)])
    assert {r[4] for r in got} <= {(1 << 63) - 1}


def test_heap_visits_every_pair_in_order():
    rng = np.random.default_rng(2)
    u1, u2 = rng.normal(size=9), rng.normal(size=5).round(1)
    got = list(hn.multi_sequence(u1, u2))
    assert len({(i, j) for _, i, j in got}) == 45
    assert [s for s, _, _ in got] == sorted((s for s, _, _ in got), reverse=True)
    assert all(s == u1[i] + u2[j] for s, i, j in got)


def test_bounds_hold_for_all_members():
    rng = np.random.default_rng(3)
    x = rng.integers(-200, 200, size=(400, 8))
    books = tuple(hn.codebook(h, 7, 1) for h in hn.halves(x))
    own = [hn.nearest(h, b) for h, b in zip(hn.halves(x), books)]
    radii = tuple(np.array([np.sqrt(((h[o == e] - b[e]) ** 2).sum(axis=1)).max(initial=0) for e in range(7)]) for h, b, o in zip(hn.halves(x), books, own))
    index = hn.Index(books, radii, *([None] * 3))
    for q in x[:50]:
        (u1, l1), (u2, l2) = hn.bounds(q, index)
        s = x @ q
        assert (s <= u1[own[0]] + u2[own[1]]).all() and (s >= l1[own[0]] + l2[own[1]]).all()
    assert hn.inner(x[:2] * (1 << 40), x[:3] * (1 << 40)).tolist() == [[max(-(2**63), min(2**63 - 1, int(a) << 80)) for a in r] for r in (x[:2] @ x[:3].T).tolist()]
