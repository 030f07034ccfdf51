import math
import random
from collections import Counter
from statistics import fmean, pstdev

import pytest
from pyspark.sql import functions as F

from flowdetect.operators import dataset
from flowdetect.plans import q_data

S = 1_000_000
SESSIONS = [("scan_0", "scan", 1000 * S + 7, 1075 * S), ("benign_1", "benign", 1100 * S, 1130 * S + 3)]


@pytest.fixture(scope="module")
def events():
    rng = random.Random(5)
    # a burst shorter than the sparse steps, and others spread over both sessions and outside
    times = [1003 * S + 20_000 * i for i in range(30)] + [rng.randrange(990 * S, 1140 * S) for _ in range(120)]
    return [(i, t, f"10.0.0.{rng.randrange(4)}", f"192.168.1.{rng.randrange(5)}", rng.choice([22, 80, 443, 8080])) for i, t in enumerate(times)]


@pytest.fixture
def small(spark, events, monkeypatch):
    marks = [(i + k * 10, (s, e)[k], f"{n}_{('start', 'end')[k]}") for i, (n, _, s, e) in enumerate(SESSIONS) for k in (0, 1)]
    tables = {
        "flows": spark.createDataFrame(events, "event_id long, ts_us long, src_ip string, dst_ip string, dst_port int"),
        "marks": spark.createDataFrame(marks, "event_id long, ts_us long, label string"),
    }
    monkeypatch.setattr(q_data, "view", lambda s, d, name: tables[name])


def instants(step):
    return [(n, label, t, s) for n, label, s, e in SESSIONS for t in range(s, e + 1, step)]


def gaps(times):
    t = sorted(times)
    g = [(b - a) / 1e6 for a, b in zip(t, t[1:])]
    return (fmean(g), pstdev(g)) if g else (0.0, 0.0)


def entropy(values):
    counts = Counter(values)
    n = sum(counts.values())
    return -sum(c / n * math.log2(c / n) for c in counts.values())


def rows(spark, name):
    return {(r.session_id, r.label, r.t_us): r for r in q_data.Q[name](spark, "").orderBy(F.col("t_us")).collect()}


def test_flood_rows_at_the_reference_step(spark, events, small):
    got, want = rows(spark, "ds1_flood_rows_full_rate"), {}
    for n, label, t, start in instants(140_000):
        if inside := [e for e in events if max(start, t - 10 * S) <= e[1] <= t]:
            want[n, label, t] = (len(inside), len({e[4] for e in inside}), len({e[2] for e in inside}), entropy(e[4] for e in inside), entropy(e[2] for e in inside), *gaps(e[1] for e in inside))
    assert got.keys() == want.keys() and len(want) > 500
    for k, w in want.items():
        r = got[k]
        assert (r.packet_rate, r.unique_dst_ports, r.unique_src_ips) == w[:3]
        assert (r.dst_port_entropy, r.src_ip_entropy, r.mean_iat, r.std_iat) == pytest.approx(w[3:], abs=6e-5)
        assert (r.source, r.label_method, r.environment) == ("real", "generator_ground_truth", "loopback")
        assert (r.scenario_id, r.attack_subtype) == (("recon_port_scan", "port_scan") if k[1] == "scan" else ("recon_benign_baseline", None))


def test_scan_rows_at_the_reference_step(spark, events, small):
    got, want = rows(spark, "ds2_scan_rows_full_rate"), {}
    for n, label, t, start in instants(150_000):
        if inside := [e for e in events if max(start, t - 60 * S) <= e[1] <= t]:
            ports = [e[4] for e in inside]
            want[n, label, t] = (len(set(ports)), len({e[3] for e in inside}), len(inside), max(ports) - min(ports), entropy(ports), *gaps(e[1] for e in inside))
    assert got.keys() == want.keys() and len(want) > 500
    for k, w in want.items():
        r = got[k]
        assert (r.unique_ports, r.unique_hosts, r.connection_count, r.port_range_span) == w[:4]
        assert (r.port_entropy, r.mean_iat, r.std_iat) == pytest.approx(w[4:], abs=6e-5)


def test_beacon_rows_at_the_reference_step(spark, events, small):
    got, want = rows(spark, "ds3_wn7_beacon_rows_full_rate"), {}
    for n, label, t, start in instants(220_000):
        last = sorted(e[1] for e in events if start <= e[1] <= t)[-20:]
        if len(last) >= 3:
            want[n, label, t] = (len(last), *gaps(last))
    assert got.keys() == want.keys() and len(want) > 300
    for k, w in want.items():
        r = got[k]
        assert r.n == w[0] and (r.mean_interval, r.std_interval) == pytest.approx(w[1:], abs=6e-5)
        assert r.cv == pytest.approx(w[2] / w[1], abs=6e-5)


def test_scenarios_by_prefix(spark):
    d = spark.createDataFrame([("benign_http_1", 0), ("ddos_2", 1), ("benign_x", 0), ("ddos_udpflood_9", 1)], "session_id string, label int")
    got = {r.session_id: (r.scenario_id, r.attack_subtype) for r in dataset.provenance(d, dataset.FLOOD_SCENARIOS, "lab").collect()}
    assert got == {"benign_http_1": ("ddos_benign_http_baseline", None), "ddos_2": ("ddos_syn_flood", "syn_flood"), "benign_x": ("ddos_benign_baseline", None), "ddos_udpflood_9": ("ddos_udp_flood", "udp_flood")}
    own = {r.session_id: (r.scenario_id, r.attack_subtype) for r in dataset.provenance(d, {}, "lab", ("m1", "fan_out")).collect()}
    assert own["ddos_2"] == ("m1", "fan_out") and own["benign_x"] == ("m1", None)
    other = spark.createDataFrame([("scan_1", 0)], "session_id string, label int")
    with pytest.raises(Exception, match="no scenario for scan_1"):
        dataset.provenance(other, dataset.FLOOD_SCENARIOS, "lab").collect()
    assert dataset.map_scenario(other, "session_id", dataset.FLOOD_SCENARIOS, strict=False).first().scenario_id is None


def test_marks_pair_by_name_within_a_file(spark):
    marks = [  # file, place, time
        ("a", 0, 10, "recon_0_start"), ("a", 1, 20, "recon_0_end"), ("a", 2, 20, "benign_1_start"), ("a", 3, 30, "benign_1_end"), ("a", 4, 40, "recon_2_start"), ("a", 5, 50, "benign_3_start"), ("a", 6, 60, "benign_3_end"),
        ("b", 0, 15, "recon_0_start"), ("b", 1, 25, "recon_0_end"), ("b", 2, 26, "recon_4_end"), ("b", 3, 30, "c2_5_start"), ("b", 4, 31, "c2_5_start"), ("b", 5, 33, "c2_5_end"),
    ]
    random.Random(1).shuffle(marks)
    d = spark.createDataFrame(marks, "file string, place int, ts_us long, label string")
    got = sorted((r.file, r.start_us, r.session_id, r.label, r.end_us, r.ok) for r in dataset.pair_marks(d, file="file", order="place").collect())
    assert got == [
        ("a", 10, "recon_0", "recon", 20, True), ("a", 20, "benign_1", "benign", 30, True), ("a", 40, "recon_2", "recon", None, False), ("a", 50, "benign_3", "benign", 60, True),
        ("b", 15, "recon_0", "recon", 25, True), ("b", 30, "c2_5", "c2", None, False), ("b", 31, "c2_5", "c2", 33, True),
    ]
    one = dataset.pair_marks(d.where("file = 'a'"), margin_us=1).where("ok").collect()
    assert sorted((r.start_us, r.end_us) for r in one) == [(11, 19), (21, 29), (51, 59)]
