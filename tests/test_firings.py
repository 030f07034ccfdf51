"""Pattern firings over blocks against the fold over whole sources."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowdetect.operators import correlate, firings, gates

ALERT = "seq long, ts_us long, event_ts double, threat_class string, src_ip string, dst_ip string, confidence double, flow_id string"
KEPT = ("src_ip", "ts_us", "seq", "priority", "pattern", "confidence", "severity", "contributing", "dst_ip", "event_ts")


def alerts(spark, rows):
    return spark.createDataFrame([(i, int(t * 1e6), float(t), c, s, "d", 0.5, f) for i, (t, c, s, f) in enumerate(rows)], ALERT)


def slim(a):
    return correlate.usable(a).select("src_ip", "ts_us", "seq", "threat_class", F.expr(correlate.identity()).alias("id"), "confidence", "dst_ip", "event_ts")


def rows(seed, n, ids, step, sources=3):
    r, t, out = random.Random(seed), 1e6, []
    for _ in range(n):
        t += r.choice((0, 0, step, 5 * step))
        flow = None if r.random() < 0.1 else f"f{r.randrange(ids)}"
        out.append((t, r.choice(("recon", "c2", "exfil", "dga", "ddos", "tls")), f"s{min(r.randrange(2 * sources), sources - 1)}", flow))
    r.shuffle(out)
    return out


@pytest.mark.parametrize("seed, n, ids, step, block", [(1, 900, 4, 20, 1800), (2, 900, 30, 45, 600), (3, 700, 10_000, 10, 3600), (4, 900, 8, 110, 1000), (5, 600, 2, 3, 14_400), (6, 900, 12, 70, 300)])
def test_blocks_equal_the_fold(spark, seed, n, ids, step, block):
    a = alerts(spark, rows(seed, n, ids, step)).persist()
    want = sorted(gates.novel_set(correlate.patterns(a)).select(*KEPT).collect())
    assert want and sorted(firings.spread(slim(a), correlate.PATTERNS, block=block).select(*KEPT).collect()) == want
    a.unpersist()


def test_next_firing_equals_plain_search():
    """Sparse ids that leave a window and come back, against sets."""
    for seed in range(300):
        r = np.random.default_rng(seed)
        n, window, hold = int(r.integers(1, 60)), int(r.integers(2, 12)), int(r.integers(2, 25))
        t = np.sort(r.integers(0, 80, n)).astype("int64")
        kind, code = np.array(["a", "b", "c"], dtype=object)[r.integers(0, 3, n)], r.integers(0, r.integers(1, 8), n)
        start, taken = int(r.integers(0, 40)), r.random(n) < 0.1
        taken &= t >= start
        p = firings.Pattern(t, kind, code, start, ["a", "b"], window, hold, taken)
        ids = lambda at: {int(c) for u, c, k in zip(t, code, kind) if k in "ab" and at - window < u <= at}  # noqa: E731, B023
        at = np.unique(np.concatenate([p.entries, p.times]))
        for x, got in zip(at.tolist(), p.after(at).tolist()):
            assert got == next((i for i, u in enumerate(p.times.tolist()) if u > x and (u - x > hold or not ids(u) <= ids(x))), len(p.times))


def test_busy_source(spark):
    classes = ("recon", "c2", "exfil")
    a = alerts(spark, [(1e6 + 3 * i, classes[i % 3], "hot", f"f{i}") for i in range(20_000)])
    d = correlate.fire(a)
    assert d.where("pattern = 'KILL_CHAIN'").count() == 20_000 - 2
    assert d.agg(F.max(F.size("contributing"))).first()[0] == 20


def test_empty_and_odd_alerts(spark):
    assert correlate.fire(alerts(spark, [])).count() == 0
    odd = alerts(spark, [(1e6, "recon", None, "x"), (1e6, None, "s", "x"), (1e6, "c2", "s", None), (1e6, "exfil", "s", None)])
    assert [r.pattern for r in correlate.fire(odd.unionByName(odd).withColumn("extra", F.lit(1))).collect()] == ["C2_EXFIL"]
