"""Frame statistics, states and readers against plain loops."""

import math
import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowdetect.functions import expr as x
from flowdetect.operators import correlate, dataset, features, gates, ml, windows
from flowdetect.plans.views import view
from flowdetect.sources import logs
from flowdetect.streaming import stream

SF = "/root/testdata/sf0.001"


def entropy(values):
    n = len(values)
    return -sum(c / n * math.log2(c / n) for c in Counter(values).values()) if n else 0.0


def deviation(gaps):
    mean = sum(gaps) / len(gaps) if gaps else 0.0
    return mean, (sum((g - mean) ** 2 for g in gaps) / len(gaps)) ** 0.5 if gaps else 0.0


def test_frame_stats_equal_a_plain_loop(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([0, 1, 2]) * 1_000_000 + rng.randrange(40) * 2_500_000, rng.choice("abc"), rng.choice([80, 443, None, 22])) for i in range(150)]
    d = spark.createDataFrame(rows, "event_id long, ts_us long, src_ip string, dst_port int")
    got = {r.event_id: r for r in windows.frame_stats(d, ["src_ip"], 10_000_000, ["dst_port"], "dst_port").collect()}
    assert len(got) == len(rows)
    for i, t, s, _ in rows:
        frame = sorted((r for r in rows if r[2] == s and t - 10_000_000 <= r[1] <= t), key=lambda r: r[1])
        ports = [r[3] for r in frame]
        mean, std = deviation([(b[1] - a[1]) / 1e6 for a, b in zip(frame, frame[1:])])
        g = got[i]
        assert (g["_n"], g["_d_dst_port"]) == (len(frame), len(set(ports)))
        assert g["_h_dst_port"] == pytest.approx(entropy(ports), abs=1e-9) and (g["_mean"], g["_std"]) == (pytest.approx(mean), pytest.approx(std, abs=1e-9))
        known = [p or 0 for p in ports]
        assert g["_span"] == max(known) - min(known)


def test_frames_at_points_and_before_zero(spark):
    rng = random.Random(8)
    rows = [(i, rng.randrange(-30, 30) * 333_333, rng.choice([None, "a"]), rng.choice([1, 2, 3]), rng.choice("xyz")) for i in range(120)]
    rows += [(200 + i, -5_000_000 + i % 3, "hot", i % 7, "x") for i in range(400)]  # a busy instant of one key
    d = spark.createDataFrame(rows, "event_id long, ts_us long, src_ip string, dst_port int, dst_ip string")
    points = [(t, k, t // 7) for t in range(-12_000_000, 12_000_000, 777_777) for k in (None, "a", "hot", "none")]
    p = spark.createDataFrame(points, "ts_us long, src_ip string, label long")
    got = {(r.ts_us, r.src_ip): r for r in windows.frame_stats(d, ["src_ip"], 2_000_000, ["dst_port", "dst_ip"], "dst_port", points=p).collect()}
    want = {}
    for t, k, _ in points:
        frame = sorted((r for r in rows if r[2] == k and t - 2_000_000 <= r[1] <= t), key=lambda r: r[1])
        if frame:
            want[t, k] = frame
    assert got.keys() == want.keys() and any(len(f) > 399 for f in want.values())
    for k, frame in want.items():
        g, ports = got[k], [r[3] for r in frame]
        mean, std = deviation([(b[1] - a[1]) / 1e6 for a, b in zip(frame, frame[1:])])
        assert (g.label, g["_n"], g["_d_dst_port"], g["_d_dst_ip"], g["_span"]) == (k[0] // 7, len(frame), len(set(ports)), len({r[4] for r in frame}), max(ports) - min(ports))
        assert (g["_h_dst_port"], g["_mean"], g["_std"]) == (pytest.approx(entropy(ports), abs=1e-8), pytest.approx(mean, abs=1e-9), pytest.approx(std, abs=1e-9))
    with pytest.raises(ValueError):
        windows.frame_stats(d, ["src_ip"], 3, ["dst_port"])


def test_sliding_sums_equal_a_plain_loop(spark):
    rng = random.Random(9)
    rows = [(i, rng.randrange(0, 60) * 250_000, rng.choice("ab"), rng.randrange(100)) for i in range(300)]
    d = spark.createDataFrame(rows, "event_id long, ts_us long, k string, v long")
    for keys in ([], ["k"]):
        got = {r.event_id: (r.n, r.total) for r in windows.sliding_sums(d, keys, 4_000_000, {"n": F.lit(1).cast("long"), "total": F.col("v")}).collect()}
        assert got == {i: (len(f), sum(r[3] for r in f)) for i, t, k, _ in rows for f in [[r for r in rows if t - 4_000_000 <= r[1] <= t and (not keys or r[2] == k)]]}
    assert windows.sliding_sums(d.limit(0), [], 4_000_000, {"n": F.lit(1).cast("long")}).count() == 0


def test_entropy_baseline_of_many_rows_in_a_window(spark):
    n = 100_000
    d = spark.range(n).selectExpr("id AS event_id", "id * 5000 AS ts_us", "round(1e4 + (id * 7919 % 10007) / 1e4, 4) AS dst_port_entropy")
    rows = features.entropy_baseline(d).where(f"event_id IN (5, {n - 1})").collect()
    values = [round(1e4 + (i * 7919 % 10007) / 1e4, 4) for i in range(n - 1)]
    mean, std = statistics.fmean(values), statistics.stdev(values)
    last = next(r for r in rows if r.event_id == n - 1)
    assert last.sigma == pytest.approx(abs(1e4 + ((n - 1) * 7919 % 10007) / 1e4 - mean) / std, abs=1e-3) and next(r for r in rows if r.event_id == 5).sigma == 0


@pytest.mark.parametrize("values", [[], [5], [1, 1, 1], [3, 1, 2, 1, 3, 3], list(range(50))])
def test_array_expressions(spark, values):
    d = spark.createDataFrame([(values,)], "a array<long>")
    r = d.select(F.expr(x.entropy("a")).alias("h"), F.expr(x.interval_stats("a")).alias("i")).first()
    order = sorted(values)
    mean, std = deviation([(b - a) / 1e6 for a, b in zip(order, order[1:])])
    assert r.h == pytest.approx(entropy(values), abs=1e-12)
    assert (r.i["mean"], r.i["std"]) == (pytest.approx(mean), pytest.approx(std, abs=1e-12))


def test_cooldown_is_greedy(spark):
    times = [0, 5, 29, 30, 31, 59, 60, 61, 200]
    d = spark.createDataFrame([(i, t * 1_000_000, "s") for i, t in enumerate(times)], "event_id long, ts_us long, src_ip string")
    assert sorted(r.event_id for r in gates.cooldown(d, ["src_ip"], 30).collect()) == [0, 3, 6, 8]
    assert gates.cooldown(d.limit(0), ["src_ip"], 30).count() == 0


@pytest.mark.parametrize("seconds,blocks", [(30, 64), (3, 2), (1, 1), (0, 2)])
def test_cooldown_across_blocks_equals_the_fold(spark, seconds, blocks):
    rng = random.Random(seconds + blocks)
    rows, t = [], -40_000_000
    for i in range(900):
        t += rng.choice([0, 0, 1, 400_000, 999_999, 1_000_000, 2_999_999, 3_000_000, 40_000_000 if rng.random() < 0.1 else 7])
        rows.append((rng.randrange(10**6) * 1000 + i, t, rng.choice(["hot", "hot", "hot", "b", None])))
    want, last = [], {}
    for e, t, k in sorted(rows, key=lambda r: (r[1], r[0])):
        if k not in last or t - last[k] >= seconds * 1_000_000:
            want.append(e)
            last[k] = t
    d = spark.createDataFrame(rows, "event_id long, ts_us long, src_ip string")
    assert sorted(r.event_id for r in gates.cooldown(d, ["src_ip"], seconds, blocks=blocks).collect()) == sorted(want)


def test_running_means_across_hours(spark):
    rng = random.Random(5)
    rows, t = [], 1_700_000_000
    for i in range(200):
        t += rng.choice([0, 1, 7, 3599, 9000])
        rows.append((i, t * 1_000_000, float(t), rng.choice(["c2", "tls", "dga"] if i > 60 else ["c2"]), "10.0.0.1"))
    d = spark.createDataFrame(rows, "seq long, ts_us long, event_ts double, threat_class string, src_ip string")
    got = {r.seq: r for r in correlate.rate_baseline(d).collect()}
    state = {}
    for seq, t, _, c, _ in rows:
        want = []
        for key in (c, "*"):
            last, m, n = state.get(key, (None, None, 0))
            if last is not None and t > last:
                gap = (t - last) / 1e6
                m, n = gap if m is None else 0.2 * gap + 0.8 * m, n + 1
            state[key] = (t, m, n)
            want.append((m, n))
        # rows of equal time share what stands after the last of them
        g = got[seq]
        assert (g.class_gap, g.class_n) == (want[0][0] if want[0][0] is None else pytest.approx(want[0][0]), want[0][1])
        assert (g.all_gap, g.all_n) == (want[1][0] if want[1][0] is None else pytest.approx(want[1][0]), want[1][1])


def test_marks_pair_across_hours(spark):
    marks = [(h * 3_000_000_000 + (1_000_000 if end else 0), f"scan_{h}_{'end' if end else 'start'}") for h in range(5) for end in (False, True)]
    d = spark.createDataFrame(marks, "ts_us long, label string")
    got = dataset.pair_marks(d).orderBy("start_us").collect()
    assert [(r.session_id, r.start_us, r.end_us, r.ok) for r in got] == [(f"scan_{h}", h * 3_000_000_000, h * 3_000_000_000 + 1_000_000, True) for h in range(5)]
    assert dataset.pair_marks(d.limit(0)).count() == 0
    clamped = dataset.clamp_windows(spark.createDataFrame([(0, 10), (50, 60)], "start_us long, end_us long"), 100)
    assert sorted(r.end_us for r in clamped.collect()) == [50, 160]


def test_manifests_need_their_marks(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "s").mkdir()
    for name in ("a", "b"):
        (tmp_path / "m" / f"{name}.json").write_text(f'{{"scenario_id": "{name}", "session_id": "s_{name}", "split": "train", "victim_ips": ["1.2.3.4"]}}')
    (tmp_path / "s" / "sessions_a.json").write_text('[{"label": "scan_1_start", "ts": 1.0}, {"label": "scan_1_end", "ts": 2.0}]')
    marks = logs.read_marks(spark, str(tmp_path / "s"))
    assert [r.scenario_id for r in logs.read_manifests(spark, str(tmp_path / "m"), marks).collect()] == ["a"]


def test_exact_stream_values_and_carry(spark, tmp_path):
    f = view(spark, SF, "flows")
    for i in range(4):
        f.where(f"event_id >= {250 * i} AND event_id < {250 * (i + 1)}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(f.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.exact(src, features.scan_features, 60, str(tmp_path / "out"), str(tmp_path / "carry"), str(tmp_path / "cp")).awaitTermination(200)
    columns = ["event_id", "unique_ports", "unique_hosts", "connection_count", "port_entropy", "std_iat"]
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(columns).collect())
    assert got == sorted(tuple(r) for r in features.scan_features(f).select(columns).collect())
    assert len([p for p in (tmp_path / "carry").iterdir() if p.name.startswith("batch=")]) == 2


def test_unseen_groups_are_left_out_of_training(spark):
    rows = spark.createDataFrame([(g, i % 2, float(i % 2)) for i, g in enumerate("aabbccdd" * 20)], "grp string, y int, v double")
    unseen = spark.createDataFrame([("d",)], "grp string")
    model = ml.train_logistic(rows.join(unseen, "grp", "left_anti"), ["v"])
    r = ml.evaluate_unseen(rows, unseen, lambda d: ml.score(model, d)).first()
    assert (r.tp, r.fp, r.tn, r.fn) == (20, 0, 20, 0)
