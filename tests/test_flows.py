import json

import pytest
from pyspark.sql import functions as F

from flowdetect.operators import correlate, custody, detect, export, features, gates, ml, normalize
from flowdetect.plans.views import view
from flowdetect.sources import logs
from flowdetect.streaming import stream

SF = "/root/testdata/sf0.001"
FLOW = "event_id long, uid string, ts_us long, src_ip string, dst_ip string, dst_port int, proto string, orig_bytes long, resp_bytes long, orig_pkts long, resp_pkts long, duration double, conn_state string, log_type string"


def flows(spark, rows):
    return spark.createDataFrame([(i, f"C{i}", int(t * 1e6), s, d, p, "tcp", ob, 300, 5, 4, 1.0, "SF", "conn") for i, (t, s, d, p, ob) in enumerate(rows)], FLOW)


def test_scan_fires_for_the_scanner_only(spark):
    rows = [(1e6 + 2 * i, "10.0.0.1", "192.168.1.1", 443, 500) for i in range(30)] + [(1e6 + 60 + 0.5 * i, "10.0.0.9", "192.168.1.2", i + 1, 500) for i in range(60)]
    got = {r.src_ip for r in detect.scan_rule(flows(spark, rows)).collect()}
    assert got == {"10.0.0.9"}


def test_each_beacon_fires_once_at_its_fifth_observation(spark):
    rows = [(2e6 + 4 * i, "10.0.0.1", "1.1.1.1", 443, 500) for i in range(10)] + [(2e6 + 1 + 6 * i, "10.0.0.1", "2.2.2.2", 443, 500) for i in range(10)]
    got = sorted((r.dst_ip, r.event_ts) for r in detect.beacon_rule(flows(spark, rows)).collect())
    assert got == [("1.1.1.1", 2e6 + 16), ("2.2.2.2", 2e6 + 25)]


def test_uploads_are_high_uploads(spark):
    rows = [(3e6 + i, "10.0.0.1", "192.168.1.1", 80, 900) for i in range(15)] + [(3e6 + 20, "10.0.0.1", "8.8.8.8", 9000, 2_000_000), (3e6 + 21, "10.0.0.1", "8.8.8.8", 9000, 2_500_000)]
    got = [json.loads(r.evidence_json)["pattern"] for r in detect.exfil_pattern(flows(spark, rows)).collect()]
    assert got == ["HIGH_UPLOAD"] * 2


def test_frame_holds_a_row_exactly_as_old_as_the_window(spark):
    got = features.flood_features(flows(spark, [(100, "a", "b", 1, 1), (110, "a", "b", 2, 1), (110.000001, "a", "b", 3, 1)])).orderBy("event_id").collect()
    assert [r.packet_rate for r in got] == [1, 2, 2]


def test_cooldown_is_greedy(spark):
    rows = flows(spark, [(t, "a", "b", 1, 1) for t in (0, 10, 29, 30, 31, 61)])
    assert sorted(r.event_id for r in gates.cooldown(rows, ["src_ip"], 30).collect()) == [0, 3, 5]


def alerts(spark, rows):
    return spark.createDataFrame([(i, int(t * 1e6), float(t), c, s, f"f{i}", 0.8, "9.9.9.9", 80) for i, (t, c, s) in enumerate(rows)], "seq long, ts_us long, event_ts double, threat_class string, src_ip string, flow_id string, confidence double, dst_ip string, dst_port int")


def test_correlation_prefers_the_kill_chain(spark):
    got = correlate.correlate(alerts(spark, [(1000, "recon", "x"), (1030, "c2", "x"), (1060, "exfil", "x")])).collect()
    assert [r.pattern for r in got] == ["KILL_CHAIN"]


def test_correlation_cold_start_and_frequent_classes_stay_quiet(spark):
    assert correlate.correlate(alerts(spark, [(1000, "dga", "x"), (1010, "tls", "x")])).count() == 0
    busy = [(1000 + 8 * i, "tls" if i % 2 else "ddos", f"s{i}") for i in range(30)]
    assert correlate.correlate(alerts(spark, busy + [(1245, "tls", "x"), (1250, "ddos", "x")])).count() == 0


def test_correlation_finds_rare_classes(spark):
    rows = [(1000 + 5 * i, ("tls" if (i // 40) % 2 else "ddos") if i % 40 == 0 else "recon", f"s{i}") for i in range(600)]
    t = 1000 + 5 * 600
    got = correlate.correlate(alerts(spark, rows + [(t + 10, "tls", "x"), (t + 25, "ddos", "x")])).where("src_ip = 'x'").collect()
    assert [r.pattern for r in got] == ["ADAPTIVE:ddos,tls"] and 0.5 <= got[0].confidence <= 0.99


@pytest.mark.parametrize(
    "rows, low, high",
    [([(0.1, 0)] * 10 + [(0.9, 1)] * 10, 0.1, 0.9), ([(0.5, 0), (0.5, 1)], 0.5, 0.5), ([(0.05 + 0.02 * i, 0) for i in range(20)] + [(0.75 + 0.02 * i, 1) for i in range(10)] + [(0.52 + 0.008 * i, 1) for i in range(10)], 0.38, 0.6)],
)
def test_threshold(spark, rows, low, high):
    t = ml.select_threshold(spark.createDataFrame(rows, "p double, y int"), 0.9).first().threshold
    assert low <= t <= high


def test_chain_breaks_where_it_was_changed(spark):
    c = custody.append(spark.createDataFrame([("c", i, f"body{i}") for i in range(5)], "chain_id string, pos long, body string"))
    assert custody.verify(c).first().valid
    bad = custody.verify(c.withColumn("body", F.expr("if(seq = 2, 'x', body)"))).first()
    assert (bad.valid, bad.broken_at, bad.detail) == (False, 2, "content changed")


def test_log_scan_skips_and_counts_bad_lines(spark, tmp_path):
    (tmp_path / "conn.log").write_text('{"ts": 1.5, "uid": "a", "id.orig_h": "10.0.0.1", "id.orig_p": "0", "orig_bytes": "7"}\nnot json\n{"ts": null, "uid": "b", "orig_bytes": "x"}\n')
    raw = logs.read_log(spark, str(tmp_path))
    assert raw.count() == 2
    got = normalize.normalize(raw).collect()
    assert [(r.uid, r.src_port, r.orig_bytes, r.log_type) for r in got] == [("a", None, 7, "conn")]
    assert normalize.split_bad(raw)[1].count() == 1
    assert logs.malformed(spark, str(tmp_path)).first().malformed == 1
    assert logs.read_blacklist(spark, str(tmp_path / "none.json")).count() == 0


def test_exports_write(spark, tmp_path):
    a = view(spark, SF, "alerts")
    export.write_cef(a, str(tmp_path / "cef"))
    export.write_stix(a, str(tmp_path / "stix"))
    export.write_csv(a, str(tmp_path / "csv"))
    assert spark.read.text(str(tmp_path / "cef")).count() == spark.read.text(str(tmp_path / "stix")).count() == 1000
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 1000


def test_stream_gates_equal_batch(spark, tmp_path):
    f = features.slow_conns(view(spark, SF, "flows").where("proto IN ('tcp', 'udp')")).where("slow_count >= 25")
    f.write.parquet(str(tmp_path / "in"))
    src = stream.file_source(spark, str(tmp_path / "in"), f.schema, "parquet")
    for name, s, b in (("cool", stream.cooldown(src, ["dst_ip", "dst_port"], 30), gates.cooldown(f, ["dst_ip", "dst_port"], 30)), ("once", stream.once(src, ["dst_ip"]), gates.first_only(f, ["dst_ip"]))):
        q = s.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert {r.event_id for r in spark.table(name).collect()} == {r.event_id for r in b.collect()}


def test_exact_stream_equals_batch(spark, tmp_path):
    f = view(spark, SF, "flows")
    f.where("event_id < 500").coalesce(1).write.parquet(str(tmp_path / "in"))
    f.where("event_id >= 500").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(f.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.exact(src, features.scan_features, 60, str(tmp_path / "out"), str(tmp_path / "carry"), str(tmp_path / "cp")).awaitTermination(120)
    got = {(r.event_id, r.unique_ports) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(got) == 1000


def test_register_adds_a_detector():
    @detect.register("mine")
    def mine(flows):
        return flows

    assert detect.REGISTRY.pop("mine") is mine
