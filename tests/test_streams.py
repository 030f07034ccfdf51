"""Tailed files, best-effort exports, resumed chains and repeated hashes."""

import time

import pytest

from flowdetect.operators import correlate, custody, detect
from flowdetect.plans.q_report import thin
from flowdetect.plans.views import view
from flowdetect.sources import tail
from flowdetect.streaming import stream

SF = "/root/testdata/sf0.001"


def run_once(spark, lines, out, marks):
    lines.writeStream.option("checkpointLocation", marks).trigger(availableNow=True).format("parquet").start(out).awaitTermination(120)
    return sorted(r.value for r in spark.read.parquet(out).collect())


def test_growing_files_are_read_once_across_restarts(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")
    (logs / "a.log").write_text("one\ntwo\nthr")
    (logs / "_hidden").write_text("no\n")
    d = lambda: tail.tail_lines(spark, str(logs), part_bytes=5)
    assert run_once(spark, d(), out, marks) == ["one", "two"]
    with (logs / "a.log").open("a") as f:
        f.write("ee\nfour\n")
    (logs / "b.log").write_text("é\n\nlong line " + "x" * 50 + "\n")
    want = sorted(["one", "two", "three", "four", "é", "", "long line " + "x" * 50])
    assert run_once(spark, d(), out, marks) == want
    assert run_once(spark, d(), out, marks) == want
    (logs / "a.log").write_text("new\n")  # rotated in place
    assert run_once(spark, d(), out, marks) == sorted([*want, "new"])


def test_ranges_of_a_file_share_its_lines(tmp_path):
    text = "".join(f"{'y' * (i * 7 % 23)}{i}\n" for i in range(500))
    (tmp_path / "f.log").write_text(text)
    for size in (1, 7, 64, 10_000):
        r = tail.TailReader({"path": str(tmp_path), "partbytes": str(size)})
        end = r.latestOffset()
        got = [v for p in r.partitions({}, end) for b in r.read(p) for v in b.column(1).to_pylist()]
        assert got == text.splitlines()


def test_a_restart_between_offset_and_batch_keeps_the_bound(tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    for name in "ab":
        (logs / name).write_text("".join(f"{name}{i:02}\n" for i in range(10)))
    options = {"path": str(logs), "maxrecords": "6", "progress": str(tmp_path / "progress.json")}
    count = lambda start, end: sum((e - start.get(n, 0)) // 4 for n, e in end.items())
    first = tail.TailReader(options)
    one = first.latestOffset()
    assert tail.TailReader(options).latestOffset() == one and count({}, one) == 6  # cut off before Spark logged it
    again = tail.TailReader(options)
    again.partitions({}, one)  # logged, then cut off: planned first by the restart
    two = again.latestOffset()
    assert count(one, two) == 6 and tail.TailReader(options).latestOffset() == two
    again.partitions(one, two)
    three = tail.TailReader(options).latestOffset()
    assert count(two, three) == 6 and all(three[n] >= two[n] >= one[n] for n in three)


def test_batches_hold_so_many_records(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    for name in "ab":
        (logs / name).write_text("".join(f"{name}{i}\n" for i in range(100)))
    seen = []
    with pytest.raises(Exception, match="progress"):
        tail.TailReader({"path": str(logs), "maxrecords": "3"})

    def start():
        lines = tail.tail_lines(spark, str(logs), max_records=64, progress=str(tmp_path / "progress.json"))
        return lines.writeStream.foreachBatch(lambda b, i: seen.append([r.value for r in b.collect()])).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="100 milliseconds").start()

    for least in (64, 200):  # the second run goes on where the first stopped
        q = start()
        for _ in range(600):
            if sum(map(len, seen)) >= least:
                break
            time.sleep(0.1)
        q.stop()
    assert sorted(v for b in seen for v in b) == sorted(f"{n}{i}" for n in "ab" for i in range(100))
    assert max(map(len, seen)) == 64


def test_an_export_that_fails_leaves_the_stream_alive(spark, tmp_path):
    alerts = view(spark, SF, "alerts").select("seq", "threat_class")
    for i in range(3):
        alerts.where(f"seq % 3 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(alerts.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    calls = []

    def export(batch, path):
        calls.append(path)
        if len(calls) == 2:
            raise OSError("no room")
        batch.write.parquet(path)

    stream.alert_sink(source, str(tmp_path / "sink"), str(tmp_path / "cp"), export, {"availableNow": True}).awaitTermination(120)
    assert len(calls) == 3 and spark.read.parquet(str(tmp_path / "sink/alerts/*")).count() == alerts.count()
    assert 0 < spark.read.parquet(str(tmp_path / "sink/export/*")).count() < alerts.count()


def test_streamed_incidents_equal_batch_ones(spark, tmp_path):
    alerts = thin(view(spark, "/root/testdata/sf0.001", "alerts"))
    for i in range(3):
        alerts.where(f"seq >= {i * 340} AND seq < {i * 340 + 340}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(alerts.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.correlate_stream(source, str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination(300)
    kept = ["seq", "src_ip", "pattern", "confidence", "severity"]
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out/incidents/*")).select(kept).collect()))
    want = sorted(map(tuple, correlate.correlate(alerts).select(kept).collect()))
    assert [r[:3] for r in got] == [r[:3] for r in want] and [r[3] for r in got] == pytest.approx([r[3] for r in want]) and len(got) > 5
    columns = ["seq", "class_gap", "class_n", "all_gap", "all_n"]
    got, want = (sorted(map(tuple, d.select(columns).collect())) for d in (spark.read.parquet(str(tmp_path / "out/baseline/*")), correlate.rate_baseline(alerts)))
    assert [(r[0], r[2], r[4]) for r in got] == [(r[0], r[2], r[4]) for r in want]
    assert all(a[k] == (b[k] if b[k] is None else pytest.approx(b[k])) for a, b in zip(got, want) for k in (1, 3))
    assert len([p for p in (tmp_path / "state").iterdir() if p.name.startswith("batch=")]) == 2


def test_chains_go_on_from_their_heads_and_break_at_replays(spark):
    rows = [(c, i, f"{c}{i}") for c, n in (("a", 6), ("b", 3), ("c", 1)) for i in range(n)]
    d = spark.createDataFrame(rows, "chain_id string, pos long, body string")
    whole = custody.append(d)
    first = custody.append(d.where("pos < 2 AND chain_id <> 'b'"))
    both = first.unionByName(custody.append(d.join(first, ["chain_id", "pos"], "left_anti").select(d.columns), custody.tail(first)))
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, whole.collect()))
    assert all(r.valid for r in custody.verify(both).collect())
    for seq, at in ((0, 0), (3, 3)):
        replayed = whole.unionByName(whole.where(f"chain_id = 'a' AND seq = {seq}"))
        bad = {r.chain_id: r for r in custody.verify(replayed).collect()}
        assert (bad["a"].valid, bad["a"].total, bad["a"].broken_at, bad["a"].detail) == (False, 7, at, "repeated record") and bad["b"].valid
    assert d.limit(1).select(custody.canonical("pos", "body")).first()[0] == '{"body":"a0","pos":0}'
    assert spark.sql("SELECT cast(NULL AS int) AS x, 1 AS y").select(custody.canonical("y", "x")).first()[0] == '{"x":null,"y":1}'


def test_a_hash_listed_twice_alerts_once(spark):
    flows = spark.createDataFrame([(1, "h", ""), (2, "x", "h"), (3, "", "")], "id int, ja3 string, ja4 string")
    listed = spark.createDataFrame([("h", "f2"), ("h", "f1"), ("", "none")], "hash string, family string")
    got = sorted((r.id, r.family, r.matched) for r in detect.blacklisted(flows, listed).collect())
    assert got == [(1, "f1", "ja3"), (2, "f1", "ja4")]
