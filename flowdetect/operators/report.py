"""Aggregates and listings over the alert table. Zero-filled reports join the
fixed key set; ties are broken by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowdetect.operators import ranks

CLASSES = ("ddos", "recon", "c2", "dga", "tls", "exfil", "MULTI_VECTOR", "MULTI_VECTOR_ANOMALY")


def _keys(df: DataFrame, name: str, values) -> DataFrame:
    return df.sparkSession.createDataFrame([(v,) for v in values], f"{name} string")


def last_alerts(a: DataFrame, n: int) -> DataFrame:
    return a.orderBy(F.desc("seq")).limit(n).orderBy("seq")


def stats(a: DataFrame, last: int = 500) -> DataFrame:
    """Count per class over the last alerts, every class present, with total."""
    n = last_alerts(a, last).groupBy("threat_class").count()
    out = _keys(a, "threat_class", CLASSES).join(F.broadcast(n), "threat_class", "left").fillna({"count": 0})
    return out.union(out.agg(F.lit("total"), F.sum("count")))


def tally(a: DataFrame, column: str) -> DataFrame:
    return a.where(f"{column} IS NOT NULL AND cast({column} AS string) <> ''").groupBy(F.col(column).cast("string").alias("key")).count()


def top_k(a: DataFrame, column: str, k: int = 8) -> DataFrame:
    return tally(a, column).orderBy(F.desc("count"), "key").limit(k)


def confidence_histogram(a: DataFrame) -> DataFrame:
    n = a.groupBy(F.expr("cast(least(9, floor(confidence * 10)) AS bigint)").alias("bin")).count()
    return a.sparkSession.range(10).withColumnRenamed("id", "bin").join(n, "bin", "left").fillna({"count": 0})


def by_hour(a: DataFrame) -> DataFrame:
    n = a.groupBy(F.expr("cast(hour(timestamp_micros(ts_us)) AS bigint)").alias("hour")).count()
    return a.sparkSession.range(24).withColumnRenamed("id", "hour").join(n, "hour", "left").fillna({"count": 0})


def timeline(a: DataFrame, buckets: int = 16) -> DataFrame:
    ends = a.agg(F.min("ts_us").alias("s"), F.max("ts_us").alias("e"))
    d = a.crossJoin(F.broadcast(ends)).withColumn("bucket", F.expr(f"cast(least({buckets - 1}, floor((ts_us - s) / greatest(e - s, 1000) * {buckets})) AS bigint)"))
    return d.groupBy("bucket", F.expr(f"if(threat_class IN ({', '.join(map(repr, CLASSES[:6]))}), threat_class, 'other')").alias("threat_class")).count()


def flow_links(a: DataFrame) -> DataFrame:
    """Links with their count and dominant class (ties: first by name)."""
    n = a.where("src_ip IS NOT NULL AND dst_ip IS NOT NULL").groupBy("src_ip", "dst_ip", "threat_class").count()
    return n.groupBy("src_ip", "dst_ip").agg(F.sum("count").alias("n"), F.min_by("threat_class", F.struct(-F.col("count"), "threat_class")).alias("dominant"))


def flow_map(a: DataFrame, k: int = 10) -> DataFrame:
    """Links between the k busiest sources and destinations."""
    links = flow_links(a)
    top = lambda c: links.groupBy(c).agg(F.sum("n").alias("t")).orderBy(F.desc("t"), c).limit(k).select(c)
    return links.join(top("src_ip"), "src_ip", "left_semi").join(top("dst_ip"), "dst_ip", "left_semi")


def summary(a: DataFrame) -> DataFrame:
    return a.sparkSession.sql("SELECT threat_class, severity, count(*) AS n FROM {a} GROUP BY GROUPING SETS ((threat_class), (severity), ())", a=a)


def class_share(a: DataFrame) -> DataFrame:
    n = a.groupBy("threat_class").count()
    w = Window.orderBy("threat_class").rowsBetween(Window.unboundedPreceding, 0)  # one row a class
    all_ = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return n.select("threat_class", F.round(F.col("count") / F.sum("count").over(all_), 6).alias("share"), F.round(F.sum("count").over(w) / F.sum("count").over(all_), 6).alias("cumulative"))


def latency(a: DataFrame, value: str) -> DataFrame:
    """count, min, upper median and max, without gathering the values: the median
    is found by quantile cuts (:func:`ranks.order_statistic`)."""
    n = a.agg(F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
    median = ranks.order_statistic(a, value, n.first()["n"] // 2)
    return n.withColumn("median", F.lit(median).cast(a.schema[value].dataType))


def rate_summary(samples: DataFrame, value: str) -> DataFrame:
    return samples.agg(F.coalesce(F.max(value), F.lit(0.0)).alias("peak"), F.coalesce(F.round(F.avg(value), 2), F.lit(0.0)).alias("mean"))


def search_alerts(a: DataFrame, threat_class: str = "all", severity: str = "all", src: str = "") -> DataFrame:
    for column, value in (("threat_class", threat_class), ("severity", severity)):
        if value != "all":
            a = a.where(F.lower(column) == value.lower())
    return a.where(F.lower("src_ip").contains(src.lower())) if src else a


def alerts_since(a: DataFrame, t0: float) -> DataFrame:
    return a.where(F.col("event_ts") >= t0)


def incidents(a: DataFrame) -> DataFrame:
    return a.where(F.col("threat_class").isin("MULTI_VECTOR", "MULTI_VECTOR_ANOMALY"))


def top_alerts(a: DataFrame, k: int = 5) -> DataFrame:
    return a.where("severity IN ('CRITICAL', 'HIGH')").orderBy(F.desc("confidence"), "seq").limit(k)


def feed(a: DataFrame, n: int = 200) -> DataFrame:
    """Newest first, one row per flow_id; null ids are all kept."""
    w = Window.partitionBy("flow_id").orderBy(F.desc("ts_us"), F.desc("seq"))
    named = a.where("flow_id IS NOT NULL").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return named.unionByName(a.where("flow_id IS NULL")).orderBy(F.desc("ts_us"), F.desc("seq")).limit(n)


def metrics_long(m: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    long = m.unpivot("detector", list(metrics), "metric", "value")
    return long.select("detector", "metric", F.expr("round(value * 100, 1)").alias("percent"))


def model_metrics(metrics: DataFrame, latencies: DataFrame, throughput: DataFrame) -> DataFrame:
    return metrics.join(latencies, "detector", "left").crossJoin(F.broadcast(throughput.limit(1)))


def latency_rank(lat: DataFrame) -> DataFrame:
    return lat.orderBy(F.desc("latency"), "detector")


def pattern_counts(incidents: DataFrame, patterns: tuple[str, ...]) -> DataFrame:
    n = incidents.groupBy(F.coalesce("pattern", F.lit("ADAPTIVE")).alias("pattern")).count()
    return _keys(incidents, "pattern", (*patterns, "ADAPTIVE")).join(n, "pattern", "left").fillna({"count": 0})


def incident_steps(incidents: DataFrame) -> DataFrame:
    """Contributing alerts in order, with the offset from the first."""
    d = incidents.select("incident_id", F.posexplode(F.array_sort("contributing")).alias("step", "c"))
    first = F.min("c.event_ts").over(Window.partitionBy("incident_id"))
    return d.select("incident_id", "step", "c.threat_class", F.round(F.col("c.event_ts") - first, 3).alias("offset"))
