"""Steps whose cost must not outgrow their input."""

import hashlib
import random
import re
import time
from collections import Counter
from math import log2

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowdetect.operators import correlate, custody, dataset, features, gates, ml, text, windows
from flowdetect.plans import q_io
from flowdetect.streaming import stream

S = 1_000_000


def final_plan(d):
    return d._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("rows", [dataset.flood_rows, dataset.scan_rows])
def test_a_grid_is_not_sent_whole(spark, rows):
    events = spark.createDataFrame([(i * S, f"a{i % 3}", f"b{i % 2}", i % 5) for i in range(60)], "ts_us long, src_ip string, dst_ip string, dst_port int")
    sessions = spark.createDataFrame([("scan_0", "scan", 0, 59 * S)], "session_id string, label string, start_us long, end_us long")
    d = rows(events, sessions)
    assert len(d.collect()) == 59 * S // (140_000 if rows is dataset.flood_rows else 150_000) + 1
    assert "Broadcast" not in final_plan(d)


def test_a_silence_is_filled_in_runs(spark):
    times = [0, 3, 3, 10, 25_000_010]
    inside = spark.createDataFrame([("c", t) for t in times], "session_id string, ts_us long")
    ends = spark.createDataFrame([("c", 1, 0, 25_000_010)], "session_id string, label int, start_us long, end_us long")
    d = dataset.history(inside, ends, 1000)
    got = sorted((r.t_us, r.n, r.mean_interval) for r in d.collect())
    assert [g[0] for g in got] == list(range(1000, 25_000_011, 1000))
    assert {g[1:] for g in got} == {(4, 0.0)}
    d = dataset.history(inside, ends, 5).where("t_us < 20 OR t_us >= 25000005")
    assert sorted((r.t_us, r.n) for r in d.collect()) == [(5, 3), (10, 4), (15, 4), (25_000_005, 4), (25_000_010, 5)]
    assert "Broadcast" not in final_plan(d) and "SortAggregate" not in final_plan(d)


def test_trigrams_of_a_long_text_in_one_pass(spark):
    long = "Ab9 élan xyzzy the-cat " * 20_000 + "q" * 400_000
    runs = [r for r in "".join(c if "a" <= c <= "z" else " " for c in long.lower()).split() if len(r) > 2]
    n = Counter()
    for run, c in Counter(runs).items():
        for i in range(len(run) - 2):
            n[run[i : i + 3]] += c
    began = time.time()
    got = {r.gram: r.logp for r in text.trigram_model(spark.createDataFrame([(long,), (None,), ("no",)], "t string"), "t").collect()}
    assert time.time() - began < 20
    assert got == {g: pytest.approx(log2(c / n.total()), abs=1e-4) for g, c in n.items()}
    short = spark.createDataFrame([("a", "Thecat.net"), ("b", None), ("c", "x-y")], "k string, q string")
    model = spark.createDataFrame([("the", -1.0), ("hec", -2.0)], "gram string, logp double")
    d = text.ngram_score(short, "k", "q", model)
    assert {r.k: r.ngram_score for r in d.collect()} == {"a": pytest.approx((-3 - 30) / 5), "b": -10.0, "c": -10.0}


@pytest.mark.parametrize("block", [5, 50_000])
def test_running_means_whatever_the_block(spark, monkeypatch, block):
    monkeypatch.setattr(correlate, "BLOCK", block)
    rng = random.Random(3)
    times = {k: sorted(rng.sample(range(40 * 3600), 60)) for k in ("c2", "dga")}  # a few an hour, hours without any
    d = spark.createDataFrame([(k, t * S) for k in times for t in times[k]], "key string, ts_us long")
    start = spark.createDataFrame([("c2", -S, 50.0, 4)], "key string, last_us long, m double, n int")
    calls = correlate._running(d, 0.2, start).collect()
    want = {}
    for k, at in times.items():
        last, m, n = (-1, 50.0, 4) if k == "c2" else (None, None, 0)
        for t in at:
            if last is not None:
                m, n = t - last if m is None else 0.2 * (t - last) + 0.8 * m, n + 1
            last = t
            want[k, t * S] = (m, n)
    assert {(r.key, r.ts_us): (r.m, r.n) for r in calls} == {k: (pytest.approx(m) if m is not None else None, n) for k, (m, n) in want.items()}
    quiet = pd.DataFrame({"key": "c2", "g": 0, "b": [0, 1, 9], "ts_us": [5 * S, 3700 * S, 33000 * S], "last_us": [None, 5 * S, 3700 * S]})
    assert correlate._local(quiet, 0.2)["n"].tolist() == [0, 1, 2]  # several hours in one call


class Held:
    def __init__(self):
        self.values = {}

    def exists(self):
        return bool(self.values)

    def get(self):
        return self.values

    put = update = lambda self, v: setattr(self, "values", v)

    def iterator(self):
        return iter(())

    def updateValue(self, k, v):
        self.values[k] = v


def test_a_long_batch_of_one_source_is_linear():
    n, p = 20_000, stream.Correlate()
    p.handle, p.held, p.fired = None, Held(), Held()
    kinds = ["recon", "c2", "dga", "exfil", "ddos", "tls", "tls"]
    d = pd.DataFrame({"seq": range(n), "ts_us": [i * 20 * S for i in range(n)], "id": [f"i{i}" for i in range(n)], "threat_class": [kinds[i % 7] for i in range(n)]})
    began = time.time()
    out = pd.concat(p.handleInputRows(("s",), iter([d]), None))
    assert time.time() - began < 15
    assert out.head(3).values.tolist() == [[2, "s", "DGA_C2", 0.88], [3, "s", "KILL_CHAIN", 0.97], [4, "s", "C2_EXFIL", 0.92]]
    assert len(p.held.values) == 45


def test_a_chain_goes_by_in_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(c, i, f"{c}{i}") for c in ("a", "b", None) for i in range(40)]
        records = spark.createDataFrame(rows, "chain_id string, pos long, body string")
        first = custody.append(records.where("pos < 25"))
        d = custody.append(records.where("pos >= 25"), custody.tail(first))
        got = {(r.chain_id, r.pos): r for r in first.collect() + d.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "MapInArrow" in final_plan(d) and "FlatMap" not in final_plan(d)
    for c in ("a", "b", None):
        last = custody.GENESIS
        for i in range(40):
            r = got[c, i]
            assert (r.seq, r.prev_hash) == (i, last) and (r.body, c) == (f"{c}{i}", c)
            last = hashlib.sha256(f"{c}{i}|{last}".encode()).hexdigest()
            assert r.record_hash == last


def test_forests_train_on_partitions_of_so_many_rows(spark, monkeypatch):
    monkeypatch.setattr(ml, "TRAINED", 20)
    rows = spark.range(300).selectExpr("id", "cast(id % 2 AS int) AS y", "cast(id % 7 + id % 2 * 9 AS double) AS a", "1D AS w").coalesce(1)
    dealt = ml._dealt(rows, ["a"], "w")
    assert max(len(p) for p in dealt.rdd.glom().collect()) <= 40 and dealt.count() == 300 and dealt.columns == ["y", "a", "w"]
    assert ml.score(ml.train_rf(rows, ["a"], 5, 3, "w"), rows).where("(p > 0.5) <> (y = 1)").count() == 0


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_shuffles_of_frames_are_cut_by_rows(spark, monkeypatch, keys):
    rows = spark.range(400).selectExpr("id", "id * 700000 AS ts_us", "id % 3 AS k", "cast(id % 7 AS int) AS v")
    make = [lambda: windows.frame_stats(rows, keys, 10 * S, ["v"], "v"), lambda: windows.sliding_sums(rows, keys, 10 * S, {"n": F.lit(1).cast("long")})]
    want = [sorted(m().collect()) for m in make]
    monkeypatch.setattr(windows, "DEALT", 20)
    for m, w in zip(make, want):
        d = m()
        assert sorted(d.collect()) == w
        assert set(re.findall(r"hashpartitioning\([^)]*, (\d+)\)", final_plan(d))) == {"20"}


def test_frames_take_one_shuffle_and_any_chunk(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(60) * 900_000, rng.choice([None, "a", "b"]), rng.choice([1, 2, None, 9])) for i in range(300)]
    d = spark.createDataFrame(rows, "event_id long, ts_us long, k string, v int")
    got = windows.frame_stats(d, ["k"], 6 * S, ["v"], "v")
    got.collect()
    assert len(re.findall(r"\bExchange hashpartitioning", final_plan(got).split("Initial Plan")[0])) == 1
    t = pa.table({"_g": ["a"] * 200 + ["b"] * 100, "_b": [0] * 100 + [1] * 200, "_t": sorted(rng.randrange(200) for _ in range(100)) * 3, "_x": [1] * 300, "_own": [True] * 300, "_row": list(range(300)), "_v0": [rng.randrange(4) for _ in range(300)], "_v": [rng.randrange(9) for _ in range(300)]})
    whole, *cut = (pa.Table.from_batches(windows._measured(iter(t.to_batches(max_chunksize=n)), 20, 1, True, n)).to_pylist() for n in (1000, 1, 7))
    assert [r["_row"] for r in whole] == list(range(300)) and all(c == whole for c in cut)


@pytest.mark.parametrize("filled,block", [(1, 1920), (20_000, 1920 * (20_000 // 3))])
def test_blocks_of_cooldowns_hold_many_candidates(spark, monkeypatch, filled, block):
    monkeypatch.setattr(gates, "FILLED", filled)
    times = [i * 1000 + i % 7 * 150 for i in range(500)]
    d = spark.createDataFrame([(i, t * S, "s") for i, t in enumerate(times)], "event_id long, ts_us long, src_ip string")
    kept = gates.cooldown(d, ["src_ip"], 30)
    want, last = [], None
    for i, t in sorted(enumerate(times), key=lambda x: (x[1], x[0])):
        if last is None or t - last >= 30:
            want.append(i)
            last = t
    assert sorted(r.event_id for r in kept.collect()) == sorted(want)
    assert f"{block * S}" in final_plan(kept)


def test_labels_are_dealt_and_the_corpus_read_once(spark, monkeypatch):
    monkeypatch.setattr(dataset, "LABELS", 5)
    calls, own = [], text.letter_runs
    monkeypatch.setattr(text, "letter_runs", lambda *a: calls.append(1) or own(*a))
    d = spark.createDataFrame([(f"u{i}", f"thecat{i}.net") for i in range(60)], "uid string, query string")
    corpus = spark.createDataFrame([("The cat, the CAT",)], "text string")
    got = dataset.lexical_rows(d, "query", corpus)
    assert {r.word_boundary_score for r in got.collect()} == {round(6 / 7, 4), round(6 / 8, 4)} and len(calls) == 1
    assert re.search(r"hashpartitioning\(_first[^)]*, 12\)", final_plan(got))
    assert ml.spread(d.coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_rounds_over_few_rows_take_one_task(spark, monkeypatch):
    rows = spark.range(300).selectExpr("cast(id % 2 AS int) AS y", "cast(id AS double) AS a", "1D AS w", "id % 5 AS fold").repartition(6)
    assert ml._dealt(rows, ["a"], "w", ml.ROUNDS).rdd.getNumPartitions() == 1
    monkeypatch.setattr(ml, "ROUNDS", 100)
    assert ml._dealt(rows, ["a"], "w", ml.ROUNDS).rdd.getNumPartitions() == 3
    pools, own = [], ml.ThreadPool
    monkeypatch.setattr(ml, "ThreadPool", lambda n: pools.append(n) or own(n))
    given = lambda fit, f: lambda held: held.withColumn("p", held.y + 0.0)
    got = ml.compare(rows, ["a"], "fold", 5, {"rf": given, "gbt": given}, light=("gbt",)).collect()
    assert pools == [4, 5] and {(r.model, r.tp, r.tn) for r in got} == {("rf", 150, 150), ("gbt", 150, 150)}


def test_a_batch_of_a_stream_comes_in_several_files(spark, monkeypatch):
    monkeypatch.setattr(q_io, "ROWS_A_FILE", 20)
    rows = spark.range(300).selectExpr("id AS event_id", "id * 1000000 AS ts_us")
    out = q_io.landed(spark, q_io.arriving(spark, rows).withColumn("at", F.input_file_name()))
    files = [(r.lo, r.hi) for r in out.groupBy("at").agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi")).collect()]
    assert len(files) == 15 and {lo // 100 == hi // 100 for lo, hi in files} == {True} and out.count() == 300


def test_new_rows_of_an_exact_batch_are_told_by_a_mark(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    for ids in ([0, 1, 2], [2, 3]):  # 2 comes again
        spark.createDataFrame([(i, i * 10 * S, "a", "b", i) for i in ids], "event_id long, ts_us long, src_ip string, dst_ip string, dst_port int").coalesce(1).write.mode("append").parquet(str(src))
    met = []

    def operator(rows):
        met.append(rows.columns)
        return features.scan_features(rows)

    rows = spark.read.parquet(str(src))
    stream.exact(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(src)), operator, 60, out, str(tmp_path / "carry"), str(tmp_path / "cp")).awaitTermination(100)
    got = spark.read.parquet(out)
    assert sorted((r.batch, r.event_id, r.connection_count) for r in got.collect()) == [(0, 0, 1), (0, 1, 2), (0, 2, 3), (1, 2, 3), (1, 3, 4)]
    assert all("_new" in columns for columns in met) and "_new" not in got.columns


def test_turns_of_all_alerts_are_numbered_in_ranges(spark):
    d = q_io.Q["sm11_combine"](spark, "/root/testdata/sf0.001")
    got = sorted(d.collect(), key=lambda r: r.turn)
    assert [r.turn for r in got] == list(range(1, len(got) + 1)) and got
    assert [tuple(r)[:3] for r in got] == sorted(tuple(r)[:3] for r in got)
    assert "row_number() windowspecdefinition(event_ts" not in final_plan(d) and d.schema["turn"].dataType.simpleString() == "int"
