"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from flowdetect.plans import registry

NAMES = [
    "entry_scan_alerts", "wn1_flood_features", "wn2_scan_features", "wn3_beacon_features", "wn4_entropy_baseline", "dt2_flood_rule", "dt3_slow_http", "dt6_beacon_rule", "dt8_dns_tunnel",
    "dt11_jn5_tls_blacklist", "jn1_join_uid", "cr2_fire", "ch2_verify", "ds1_flood_rows_full_rate", "ds2_scan_rows", "ds2_scan_rows_full_rate", "exp2_cef",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.adaptive.coalescePartitions.enabled", "false").config("spark.local.dir", scratch).config("spark.checkpoint.dir", f"file://{scratch}/checkpoint").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    flows = spark.read.parquet(f"{sf}/events.parquet").count()
    registry.queries()[NAMES[0]](spark, sf).write.format("noop").mode("overwrite").save()  # code compiles, unmeasured
    took = {}
    for name in NAMES:
        began = time.time()
        registry.queries()[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    rules = sum(took[n] for n in ("entry_scan_alerts", "dt2_flood_rule", "dt3_slow_http", "dt6_beacon_rule"))
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf, "flows_per_s_rules": round(flows / rules, 1)}))


if __name__ == "__main__":
    main()
