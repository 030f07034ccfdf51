"""Multi-stage correlation of alerts per source."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowdetect.functions import expr as x
from flowdetect.operators import firings, gates

# Classes, window in seconds, confidence, severity by priority.
PATTERNS = (
    ("KILL_CHAIN", ("recon", "c2", "exfil"), 600, 0.97, "CRITICAL"),
    ("C2_EXFIL", ("c2", "exfil"), 600, 0.92, "CRITICAL"),
    ("DGA_C2", ("dga", "c2"), 120, 0.88, "HIGH"),
    ("RECON_DDOS", ("recon", "ddos"), 300, 0.85, "HIGH"),
)
S = 1_000_000


def usable(alerts: DataFrame) -> DataFrame:
    """Alerts with source, class and time that are no incidents themselves."""
    return alerts.where("src_ip IS NOT NULL AND src_ip <> '' AND threat_class IS NOT NULL AND event_ts IS NOT NULL AND threat_class NOT LIKE 'MULTI_VECTOR%'")


def identity() -> str:
    return "coalesce(flow_id, concat(cast(ts_us AS string), ':', threat_class))"


def patterns(alerts: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """Candidate firings: an alert completes a pattern when all its classes
    occur for the source within the window that ends at the alert. ``held``:
    earlier alerts that windows may reach, without firings of their own."""
    d = usable(alerts).withColumn("_new", F.lit(True))
    if held is not None:
        d = d.unionByName(usable(held).withColumn("_new", F.lit(False)))
    row = F.struct("ts_us", "seq", "threat_class", F.expr(identity()).alias("id"), "confidence")
    for p, (name, _, seconds, _, _) in enumerate(PATTERNS):
        w = Window.partitionBy("src_ip").orderBy("ts_us").rangeBetween(-(seconds * S - 1), 0)
        d = d.withColumn(f"_p{p}", F.collect_list(row).over(w))
    parts = []
    for p, (name, classes, _, confidence, severity) in enumerate(PATTERNS):
        need = f"array({', '.join(map(repr, classes))})"
        parts.append(f"CASE WHEN size(array_except({need}, _p{p}.threat_class)) = 0 THEN named_struct('priority', {p}, 'pattern', '{name}', 'conf', {confidence}D, 'sev', '{severity}', 'rows', filter(_p{p}, r -> array_contains({need}, r.threat_class))) END")
    d = d.where("_new").select("seq", "ts_us", "event_ts", "src_ip", "dst_ip", F.explode(F.expr(f"array_compact(array({', '.join(parts)}))")).alias("f"))
    return d.select("src_ip", "ts_us", "seq", "f.priority", "f.pattern", F.col("f.conf").alias("confidence"), F.col("f.sev").alias("severity"), F.expr("array_distinct(f.rows.id)").alias("ids"), F.expr("slice(array_sort(f.rows), greatest(size(f.rows) - 19, 1), 20)").alias("contributing"), "dst_ip", "event_ts")


def gaps(alerts: DataFrame) -> DataFrame:
    """seq with the seconds since the previous alert of its class and since the
    previous one of all; null at the first and where the time does not advance.
    The order of all alerts is cut into hours: only the last time of each hour
    meets in one window."""
    d = alerts.withColumn("_b", F.expr("ts_us DIV 3600000000"))
    own = Window.partitionBy("_b").orderBy("event_ts", "seq")
    last = d.groupBy("_b").agg(F.max("event_ts").alias("_m")).withColumn("_m", F.lag("_m").over(Window.orderBy("_b")))
    cls = Window.partitionBy("threat_class").orderBy("event_ts", "seq")
    d = d.withColumns({"_c": F.lag("event_ts").over(cls), "_a": F.lag("event_ts").over(own)}).join(last, "_b").withColumn("_a", F.coalesce("_a", "_m"))
    gap = "CASE WHEN event_ts > {0} THEN round(event_ts - {0}, 3) END".format
    return d.selectExpr("seq", f"{gap('_c')} AS class_gap", f"{gap('_a')} AS all_gap")


def fire(alerts: DataFrame) -> DataFrame:
    """Firings that are news; a suppressed pattern leaves room for the next. No
    alert gathers its window and no source is one task: see :mod:`firings`."""
    d = usable(alerts).select("src_ip", "ts_us", "seq", "threat_class", F.expr(identity()).alias("id"), "confidence", "dst_ip", "event_ts")
    return firings.spread(d, PATTERNS)


HOUR = 3600 * S
FIRST = -(1 << 40)  # the bucket of what stood before
BLOCK = 50_000  # times of a key, by whole hours, that one call of a function takes


def _local(rows: pd.DataFrame, alpha: float) -> pd.DataFrame:
    """Of one key's block: after each time, the running mean as an affine map of
    the mean that comes in: add + keep * m, with the gaps so far and the first
    gap (a missing m counts as that). A time that does not advance has no gap."""
    rows = rows.sort_values("ts_us")
    t = rows["ts_us"].to_numpy()
    before = rows["last_us"].iloc[0]
    reached = np.maximum.accumulate(t if pd.isna(before) else np.maximum(t, int(before)))
    gap = np.diff(reached, prepend=reached[0] if pd.isna(before) else int(before)) / 1e6
    add, keep, n, adds, keeps, counts = 0.0, 1.0, 0, [], [], []
    for g in gap.tolist():
        if g > 0:
            add, keep, n = alpha * g + (1 - alpha) * add, (1 - alpha) * keep, n + 1
        adds.append(add)
        keeps.append(keep)
        counts.append(n)
    own = gap[gap > 0]
    return pd.DataFrame({"key": rows["key"].iloc[0], "g": rows["g"].iloc[0], "b": rows["b"].to_numpy(), "ts_us": t, "add": adds, "keep": keeps, "n": counts, "first": own[0] if len(own) else np.nan})


def _carried(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one key's blocks: the mean and the gaps that come into each."""
    rows = rows.sort_values("g")
    m, n, means, counts = np.nan, 0, [], []
    for add, keep, k, first in rows[["add", "keep", "n", "first"]].itertuples(index=False):
        means.append(m)
        counts.append(n)
        if k:
            m = add + keep * (first if np.isnan(m) else m)
        n += k
    return pd.DataFrame({"key": rows["key"], "g": rows["g"], "m0": means, "n0": counts})


def _running(times: DataFrame, alpha: float, start: DataFrame | None = None) -> DataFrame:
    """(key, b, ts_us, m, n) after every distinct time of a key. Steps of the
    mean are affine maps: they are composed within blocks, the blocks (a row
    each) are scanned, and what comes in is put into the blocks' maps. A block is
    as many of a key's hours ``b`` as hold ``BLOCK`` times, so quiet hours do not
    cost a call each. ``start`` (key, last_us, m, n): where keys stood before, as
    :func:`tempo` gives it."""

    def local(rows: pd.DataFrame) -> pd.DataFrame:
        return _local(rows, alpha)

    d = times.distinct().withColumn("b", F.expr(f"ts_us DIV {HOUR}"))
    ends = d.groupBy("key", "b").agg(F.max("ts_us").alias("last_us"), F.count("*").alias("k"))
    if start is not None:
        ends = ends.unionByName(start.select("key", F.lit(FIRST).alias("b"), "last_us", F.lit(0).cast("long").alias("k")))
    before = Window.partitionBy("key").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("key", "b", F.max("last_us").over(before).alias("last_us"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("k")).withColumn("g", F.expr(f"k DIV {BLOCK}")).drop("k")
    inside = d.join(ends, ["key", "b"]).groupBy("key", "g").applyInPandas(local, "key string, g long, b long, ts_us long, add double, keep double, n int, first double")
    last = inside.groupBy("key", "g").agg(F.max_by(F.struct("add", "keep", "n", "first"), "ts_us").alias("r")).select("key", "g", "r.*")
    if start is not None:
        last = last.unionByName(start.select("key", F.lit(FIRST).alias("g"), F.col("m").alias("add"), F.lit(0.0).alias("keep"), "n", F.col("m").alias("first")))
    come = last.groupBy("key").applyInPandas(_carried, "key string, g long, m0 double, n0 int")
    m = "if(n0 + n = 0, null, add + keep * coalesce(nanvl(m0, null), nanvl(first, null), 0D))"
    return inside.join(come, ["key", "g"]).selectExpr("key", "b", "ts_us", f"{m} AS m", "n0 + n AS n")


ALL = ""  # the key of all alerts; no usable alert has it for its class


def _tempos(alerts: DataFrame) -> DataFrame:
    return alerts.select(F.col("threat_class").alias("key"), "ts_us").union(alerts.select(F.lit(ALL), "ts_us"))


def tempo(alerts: DataFrame, alpha: float = 0.2, start: DataFrame | None = None) -> DataFrame:
    """(key, last_us, m, n): where the running mean gaps of each class and of
    all alerts stand after ``alerts``, on from ``start``: a row for each class."""
    now = _running(_tempos(usable(alerts)), alpha, start)
    now = now.groupBy("key").agg(F.max("ts_us").alias("last_us"), F.max_by(F.struct("m", "n"), "ts_us").alias("v")).select("key", "last_us", "v.m", "v.n")
    if start is None:
        return now
    both = now.withColumn("k", F.lit(1)).unionByName(start.withColumn("k", F.lit(0)))
    best = both.groupBy("key").agg(F.max("last_us").alias("last_us"), F.max_by(F.struct("m", "n"), "k").alias("v"))
    return best.select("key", "last_us", "v.m", "v.n")


def rate_baseline(alerts: DataFrame, alpha: float = 0.2, start: DataFrame | None = None) -> DataFrame:
    """Adds class_gap, class_n, all_gap, all_n: the running mean gaps of the
    alert's class and of all alerts, after this alert; times that do not advance
    change nothing. ``start``: see :func:`tempo`."""
    d = usable(alerts)
    at = _running(_tempos(d), alpha, start).select("key", "ts_us", "m", "n")
    d = d.join(at.select(F.col("key").alias("threat_class"), "ts_us", F.col("m").alias("class_gap"), F.col("n").alias("class_n")), ["threat_class", "ts_us"])
    return d.join(at.where(F.col("key") == ALL).select("ts_us", F.col("m").alias("all_gap"), F.col("n").alias("all_n")), "ts_us")


def adaptive(alerts: DataFrame, threshold: float = 3.0, alpha: float = 0.2, start: DataFrame | None = None, held: DataFrame | None = None) -> DataFrame:
    """Candidates of the statistical layer: two classes or more in the adaptive
    window whose joint chance is small. Each class counts with its latest gap
    at the alert. ``start`` and ``held``: see :func:`correlate`."""
    d = usable(alerts)
    hist = _running(_tempos(d), alpha, start)
    rows = d.withColumn("_new", F.lit(True))
    if held is not None:
        rows = rows.unionByName(usable(held).withColumn("_new", F.lit(False)))
    row = F.struct("ts_us", "seq", "threat_class", F.expr(identity()).alias("id"), "confidence")
    w = Window.partitionBy("src_ip").orderBy("ts_us").rangeBetween(-(900 * S - 1), 0)
    d = rows.withColumn("_a", F.collect_list(row).over(w)).where("_new").drop("_new")
    d = d.join(hist.where(F.col("key") == ALL).select("ts_us", F.col("m").alias("all_gap")), "ts_us").withColumn("window", F.expr(x.adaptive_window("all_gap")))
    d = d.withColumn("_r", F.expr("filter(_a, r -> r.ts_us > ts_us - cast(window * 1000000 AS bigint))"))
    d = d.withColumn("classes", F.expr("array_sort(array_distinct(_r.threat_class))")).where("size(classes) >= 2")
    # the class gaps as of the alert: the last update of the class within the hour, else the one that came into it
    pairs = d.select("seq", "ts_us", "window", F.explode("classes").alias("key")).withColumn("b", F.expr(f"ts_us DIV {HOUR}"))
    both = pairs.selectExpr("key", "b", "ts_us", "1 AS k", "seq", "window", "cast(null AS struct<m:double,n:int>) AS v").unionByName(
        hist.selectExpr("key", "b", "ts_us", "0 AS k", "cast(null AS bigint) AS seq", "cast(null AS double) AS window", "struct(m, n) AS v"))
    if start is not None:
        both = both.unionByName(start.selectExpr("key", f"{FIRST}L AS b", "last_us AS ts_us", "0 AS k", "cast(null AS bigint) AS seq", "cast(null AS double) AS window", "struct(m, n) AS v"))
    asof = Window.partitionBy("key", "b").orderBy("ts_us", "k").rowsBetween(Window.unboundedPreceding, 0)
    hours = both.groupBy("key", "b").agg(F.max_by("v", F.when(F.col("v").isNotNull(), F.col("ts_us"))).alias("v"))
    hours = hours.select("key", "b", F.last("v", True).over(Window.partitionBy("key").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)).alias("v0"))
    both = both.withColumn("v", F.last("v", True).over(asof)).where("k = 1").join(hours, ["key", "b"], "left")
    both = both.withColumn("v", F.coalesce("v", "v0")).selectExpr("seq", "window", "v.m AS g", "v.n AS m")
    p = F.greatest(F.expr(x.poisson_p("window", "g", "coalesce(m, 0)")), F.lit(1e-6))
    score = both.groupBy("seq").agg(F.sum(-F.log(p)).alias("score"))
    d = d.join(score, "seq").where(F.col("score") >= threshold)
    return d.selectExpr("src_ip", "ts_us", "seq", "99 AS priority", "concat('ADAPTIVE:', array_join(classes, ',')) AS pattern", "least(0.99D, 1 - exp(-score)) AS confidence", "if(size(classes) >= 3, 'CRITICAL', 'HIGH') AS severity",
                        "array_distinct(_r.id) AS ids", "slice(array_sort(_r), greatest(size(_r) - 19, 1), 20) AS contributing", "dst_ip", "event_ts")


def combine(*detectors: DataFrame) -> DataFrame:
    """Alerts of several detectors in the order of evaluation: by event, then by
    detector as given. ``detector_rank`` and the event's time and id are the sort
    key; no global order is computed."""
    out = None
    for rank, d in enumerate(detectors):
        d = d.withColumn("detector_rank", F.lit(rank))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def correlate(alerts: DataFrame, start: DataFrame | None = None, held: DataFrame | None = None, fired: DataFrame | None = None) -> DataFrame:
    """Incidents of both layers: the statistical one fires where no pattern did.
    A stream goes on from what stood before: ``start`` (:func:`tempo`), ``held``
    (alerts of the last 900 s) and ``fired`` (:func:`last_fired`); its incidents
    hold the ids that the next batch asks for."""
    if start is None and held is None and fired is None:
        known = fire(alerts)
        rest = adaptive(alerts).join(known.select("src_ip", "seq"), ["src_ip", "seq"], "left_anti")
        return known.unionByName(gates.novel_set(rest).drop("ids"))
    return gates.novel_set(patterns(alerts, held).unionByName(adaptive(alerts, start=start, held=held)), fired=fired)


def last_fired(incidents: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(src_ip, pattern, ts_us, ids): each pattern's last firing for a source."""
    own = incidents.select("src_ip", "pattern", "ts_us", "seq", "ids")
    if before is not None:
        own = own.unionByName(before.select("src_ip", "pattern", "ts_us", F.lit(None).cast("long").alias("seq"), "ids"))
    last = own.groupBy("src_ip", "pattern").agg(F.max_by(F.struct("ts_us", "ids"), F.struct("ts_us", "seq")).alias("v"))
    return last.select("src_ip", "pattern", "v.ts_us", "v.ids")


def assemble(incidents: DataFrame) -> DataFrame:
    """Incidents in the alert schema, in addition to the alerts themselves."""
    return incidents.selectExpr(
        "seq", "event_ts", "src_ip", "dst_ip", "if(priority = 99, 'MULTI_VECTOR_ANOMALY', 'MULTI_VECTOR') AS threat_class", "severity", "round(least(confidence, 0.99D), 2) AS confidence",
        "pattern", "contributing", "cast(null AS string) AS detection_method",
    )
