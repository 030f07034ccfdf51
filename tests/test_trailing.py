"""Trailing states of a key over several batches against plain loops."""

import math
import random
import statistics

import pandas as pd
import pytest

from flowdetect.streaming import stream


class Cell:
    def __init__(self):
        self.rows = None

    def exists(self):
        return self.rows is not None

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = list(rows)

    def getListState(self, *_):  # noqa: N802 - the handle's name for it
        return self


def batches(processor, parts, value):
    processor.init(Cell())
    out = []
    for part in parts:
        rows = pd.DataFrame(part, columns=["ts_us", "event_id", value])
        out += [r for d in processor.handleInputRows(("k",), iter([rows]), None) for r in d.itertuples(index=False)]
    return {r.event_id: r for r in out}


def parts(seed, n):
    r = random.Random(seed)
    rows = sorted((r.randrange(0, 400) * 1_000_000, i, r.randrange(5)) for i in range(n))
    cuts = [0, n // 3, n // 2, n]
    return rows, [rows[a:b] for a, b in zip(cuts, cuts[1:])]


@pytest.mark.parametrize("seed", range(5))
def test_last_seconds(seed):
    rows, cut = parts(seed, 120)
    got = batches(stream.Trailing(60, None, "dst_port"), cut, "dst_port")
    for i, (t, e, _) in enumerate(rows):
        held = [v for u, _, v in rows[: i + 1] if u >= t - 60_000_000]
        assert (got[e].n, got[e].distinct) == (len(held), len(set(held)))


@pytest.mark.parametrize("seed", range(5))
def test_last_rows_with_intervals(seed):
    rows, cut = parts(seed, 90)
    cut = [[(t, e) for t, e, _ in part] for part in cut]
    processor = stream.Beacon(None, 20, "event_id")
    processor.init(Cell())
    got = {}
    for part in cut:
        d = pd.DataFrame(part, columns=["ts_us", "event_id"])
        got |= {r.event_id: r for out in processor.handleInputRows(("k",), iter([d]), None) for r in out.itertuples(index=False)}
    for i, (_, e, _) in enumerate(rows):
        t = [u / 1e6 for u, _, _ in rows[max(0, i - 19) : i + 1]]
        gaps = [b - a for a, b in zip(t, t[1:])]
        assert got[e].n == len(t)
        if not gaps:
            assert got[e].cv is None and got[e].mean_interval == 0
        else:
            mean, std = statistics.fmean(gaps), statistics.pstdev(gaps)
            assert math.isclose(got[e].mean_interval, mean) and math.isclose(got[e].std_interval, std, abs_tol=1e-9)
            assert math.isclose(got[e].cv, std / mean) if mean else got[e].cv == float("inf")


def test_a_late_row_finds_its_place():
    got = batches(stream.Trailing(60, None, "dst_port"), [[(100_000_000, 0, 1)], [(50_000_000, 1, 2), (120_000_000, 2, 3)]], "dst_port")
    assert [(got[i].n, got[i].distinct) for i in range(3)] == [(1, 1), (2, 2), (2, 2)]


class Bytes(Cell):
    def get(self):
        return self.rows

    def update(self, value):
        self.rows = value

    def getValueState(self, *_):  # noqa: N802
        return self


def test_channels_of_a_bucket_equal_each_alone():
    r = random.Random(4)
    rows = [(r.randrange(300) * 1_000_000, i, r.choice(["a", "b", "c", "once"] if i % 9 else ["late"])) for i in range(400)]
    rows.sort()
    cut = [rows[:150], rows[150:151], [x for x in rows[151:] if x[0] % 2_000_000], [x for x in rows[151:] if not x[0] % 2_000_000]]  # the last one late
    both, calls = stream.Channels(20), []
    both.init(Bytes())
    for part in cut:
        d = pd.DataFrame([(c, t, e) for t, e, c in part], columns=["channel", "ts_us", "event_id"])
        calls += list(both.handleInputRows((0,), iter([d[:40], d[40:]] if len(d) > 40 else [d]), None))
    got = {x.event_id: x for d in calls for x in d.itertuples(index=False)}
    assert len(got) == len(rows) and len(calls) <= 4 + 5
    for c in ("a", "b", "c", "once", "late"):
        alone = stream.Beacon(None, 20, "event_id")
        alone.init(Cell())
        for part in cut:
            d = pd.DataFrame([(t, e) for t, e, k in part if k == c], columns=["ts_us", "event_id"])
            for x in (y for out in (stream.Trailing.handleInputRows(alone, ("k",), iter([d]), None) if len(d) else []) for y in out.itertuples(index=False)):
                g = got[x.event_id]
                assert (g.n, g.distinct) == (x.n, x.distinct) and math.isclose(g.mean_interval, x.mean_interval) and math.isclose(g.std_interval, x.std_interval, abs_tol=1e-9)
                assert (g.cv is None) == (x.cv is None) and (x.cv is None or math.isclose(g.cv, x.cv))
