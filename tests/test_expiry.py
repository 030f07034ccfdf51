"""Keyed states on streams that go once the watermark has passed them."""

from __future__ import annotations

import pytest

from flowdetect.operators import gates
from flowdetect.streaming import stream

SCHEMA = "event_id long, ts_us long, src_ip string, dst_port long"
# one file is one micro-batch; key b falls silent after the first
BATCHES = [
    [(1, 1_000_000, "a", 1), (2, 5_000_000, "a", 2), (3, 6_000_000, "b", 3), (4, 31_000_000, "a", 1)],
    [(5, 40_000_000, "a", 9), (6, 62_000_000, "a", 9), (7, 500_000_000, "a", 4)],
    [(8, 501_000_000, "a", 4), (9, 900_000_000, "b", 5)],
    [(10, 905_000_000, "b", 5), (11, 930_000_000, "b", 6)],
]


@pytest.fixture()
def arriving(spark, tmp_path):
    for i, rows in enumerate(BATCHES):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run(operator):
        src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = operator(src).writeStream.format("memory").queryName("expiry").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(200)
        assert q.exception() is None
        removed = sum(o["numRowsRemoved"] + o["customMetrics"].get("numExpiredTimers", 0) for p in q.recentProgress for o in p["stateOperators"])
        return spark.table("expiry"), removed

    return run


def test_cooldown_forgets_silent_keys(spark, arriving):
    rows, removed = arriving(lambda d: stream.cooldown(d, ["src_ip"], 30, "10 seconds"))
    want = gates.cooldown(spark.createDataFrame([r for b in BATCHES for r in b], SCHEMA), ["src_ip"], 30)
    assert rows.columns == want.columns
    assert sorted(rows.collect()) == sorted(want.collect())
    assert removed > 0


def test_trailing_state_forgets_silent_keys(arriving):
    rows, removed = arriving(lambda d: stream.scan_state(d, 60, "10 seconds"))
    flat = [r for b in BATCHES for r in b]
    want = []
    for e, t, k, _ in flat:
        frame = [p for _, u, j, p in flat if j == k and t - 60_000_000 <= u <= t]
        want.append((e, len(frame), len(set(frame))))
    assert sorted(tuple(r) for r in rows.collect()) == want
    assert removed > 0
