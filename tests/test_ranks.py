"""Ranks, order statistics, folds and the capture window against plain loops."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowdetect.operators import dataset, ml, ranks, report

S = 1_000_000


def test_numbers_equal_row_number_in_two_hot_groups(spark):
    d = spark.range(40_000).selectExpr("id", "if(id % 3 = 0, 'a', if(id % 7 = 1, null, 'b')) AS g", "md5(cast(id AS string)) AS h", "id % 5 AS _x")
    got = ranks.numbered(d, [F.desc("h"), "id"], ("g",), "i", "n", parts=16)
    assert got.columns == ["id", "g", "h", "_x", "i", "n"]
    rows = got.collect()
    for g in ("a", "b", None):
        own = sorted((r for r in rows if r.g == g), key=lambda r: r.h, reverse=True)
        assert [r.i for r in own] == list(range(len(own))) and {r.n for r in own} == {len(own)}
    assert len(rows) == 40_000


def test_no_task_holds_a_group(spark):
    d = spark.range(40_000).selectExpr("id", "id % 2 AS g")
    at = ranks.numbered(d, ["id"], ("g",), "i", parts=16)
    plan = at._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line and "row_number" in line]
    assert windows and all("_p#" in line for line in windows)  # numbered within ranges
    assert at.select(F.max("i")).first()[0] == 19_999


def test_numbers_without_groups_and_of_an_empty_table(spark):
    d = spark.createDataFrame([(3,), (None,), (1,), (1,)], "v int")
    assert sorted((r.v is not None, r.v or 0, r["_i"]) for r in ranks.numbered(d, ["v"]).collect()) == [(False, 0, 0), (True, 1, 1), (True, 1, 2), (True, 3, 3)]
    assert ranks.numbered(d.where("v > 9"), ["v"], ("v",)).collect() == []


@pytest.mark.parametrize("shape", ["rand(3)", "exp(40 * rand(3))", "if(rand(3) < 0.7, 5.0, 100 * rand(4))", "if(id = 7, 1e9, rand(5))", "if(id % 10 = 0, null, if(id % 10 = 1, double('NaN'), -rand(6)))"])
def test_order_statistics_of_any_distribution(spark, shape):
    d = spark.range(6_000).selectExpr(f"cast({shape} AS double) AS v").persist()
    values = sorted((r.v for r in d.where("v IS NOT NULL").collect()), key=lambda v: (v != v, v))
    for k in (0, 17, len(values) // 2, len(values) - 1):
        got = ranks.order_statistic(d, "v", k, splits=8, few=50)
        assert got == values[k] or (got != got and values[k] != values[k])
    assert ranks.order_statistic(d, "v", len(values)) is None
    one = report.latency(d, "v").first()
    assert (one["n"], one["median"]) == (len(values), values[len(values) // 2])
    d.unpersist()


def test_latency_of_nothing(spark):
    one = report.latency(spark.createDataFrame([], "v int"), "v").first()
    assert (one["n"], one["low"], one["median"]) == (0, None, None)


def greedy(sizes, k):
    loads = [0] * k
    for s in sorted(sizes, reverse=True):
        loads[loads.index(min(loads))] += s
    return loads


def test_packing_by_classes_equals_the_greedy_loop():
    rng = random.Random(4)
    for _ in range(300):
        k = rng.randrange(1, 8)
        sizes = [rng.choice([1, 1, 1, 2, 3, 7, 50, 400]) for _ in range(rng.randrange(0, 120))]
        plan = ml._packed(list(Counter(sizes).items()), k)
        loads = [0] * k
        for s, upto in plan:
            for f in range(k):
                loads[f] += s * (upto[f] - (upto[f - 1] if f else 0))
            assert upto[-1] == sizes.count(s)
        assert loads == greedy(sizes, k)


def test_packed_folds_keep_groups_whole(spark):
    sizes = [90, 40, 40, 12, 5, 5, 5] + [1] * 200
    rows = spark.createDataFrame([(f"g{i}" if i else None, j) for i, s in enumerate(sizes) for j in range(s)], "grp string, j int")
    got = ml.packed_folds(rows, "grp", 4)
    assert got.columns == ["grp", "j", "fold"] and got.count() == sum(sizes)
    assert got.groupBy("grp").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    loads = {r.fold: r["count"] for r in got.groupBy("fold").count().collect()}
    assert [loads[f] for f in range(4)] == greedy(sizes, 4)
    assert ml.packed_folds(rows.where("j < 0"), "grp", 4).collect() == []


def test_systematic_sample_and_small_groups(spark):
    d = spark.createDataFrame([(g, i) for g, n in (("a", 10), ("b", 37), ("c", 200)) for i in range(n)], "g string, i int")
    got = {}
    for r in dataset.systematic_sample(d, "g", ["i"], 10).collect():
        got.setdefault(r.g, []).append(r.i)
    assert {g: sorted(v) for g, v in got.items()} == {g: [k * n // 10 for k in range(10)] for g, n in (("a", 10), ("b", 37), ("c", 200))}
    with pytest.raises(Exception, match="too few rows in a"):
        dataset.systematic_sample(d, "g", ["i"], 11).collect()


def test_the_gate_looks_only_at_the_captures_own_window(spark):
    flows = spark.createDataFrame([(5 * S, "10.0.0.1", "10.0.0.2"), (20 * S, "10.0.0.3", "10.0.0.2"), (84 * S, "127.0.0.1", "127.0.0.1"), (86 * S, "127.0.0.1", "10.0.0.9"), (None, "10.0.0.9", "10.0.0.2")], "ts_us long, src_ip string, dst_ip string")
    ips = spark.createDataFrame([("10.0.0.1",), ("10.0.0.3",)], "ip string")
    marks = spark.createDataFrame([(10 * S,), (20 * S,)], "ts_us long")
    run = lambda f, **k: {r.check: (r.level, r.n) for r in dataset.validate(f, ips, **k).collect()}
    got = run(flows, marks=marks, multihost=True)
    assert got["absent_addresses"] == ("FAIL", 1) and got["outside_window"] == ("INFO", 3) and got["loopback"] == ("FAIL", 1) and got["self"] == ("FAIL", 1)
    assert got["empty"] == got["no_window"] == got["missing_fields"] == ("PASS", 0)
    assert run(flows, marks=marks)["self"] == ("INFO", 1)
    late = run(flows.where("ts_us < 6000000"), marks=marks)
    assert late["empty"] == ("FAIL", 1) and late["absent_addresses"] == ("FAIL", 2)
    none = run(flows, marks=marks.where("ts_us < 0"))
    assert none["no_window"] == ("WARN", 1) and none["outside_window"] == ("PASS", 0) and none["absent_addresses"] == ("PASS", 0) and none["missing_fields"] == ("FAIL", 1)
    assert "empty" not in run(flows)
