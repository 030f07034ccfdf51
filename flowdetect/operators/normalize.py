"""Raw log records to one event schema. A null field counts as absent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUMBERS = {"orig_bytes": "bigint", "resp_bytes": "bigint", "orig_pkts": "bigint", "resp_pkts": "bigint", "duration": "double"}
KIND = "CASE WHEN sizes IS NOT NULL AND gaps IS NOT NULL THEN 'pktseq' WHEN query IS NOT NULL THEN 'dns' WHEN ja3 IS NOT NULL OR (server_name IS NOT NULL AND coalesce(version, '') LIKE 'TLS%') THEN 'ssl' WHEN server_name IS NOT NULL THEN 'quic' ELSE 'conn' END"


def _bad() -> str:
    ports = " OR ".join(f"(`{c}` IS NOT NULL AND try_cast(`{c}` AS int) IS NULL)" for c in ("id.orig_p", "id.resp_p"))
    return f"({ports}) OR " + " OR ".join(f"({c} IS NOT NULL AND try_cast({c} AS {t}) IS NULL)" for c, t in NUMBERS.items())


def common(raw: DataFrame) -> DataFrame:
    """Stable names; port 0 is null; ``ts_us`` beside ``ts``."""
    return raw.selectExpr(
        "cast(coalesce(ts, 0D) AS double) AS ts", "cast(coalesce(ts, 0D) * 1000000 AS bigint) AS ts_us", "uid", "`id.orig_h` AS src_ip", "nullif(try_cast(`id.orig_p` AS int), 0) AS src_port",
        "`id.resp_h` AS dst_ip", "nullif(try_cast(`id.resp_p` AS int), 0) AS dst_port", *(c for c in raw.columns if "." not in c and c not in ("ts", "uid")),
    )


def split_bad(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records that convert, and those that do not."""
    bad = F.expr(f"coalesce({_bad()}, false)")
    return raw.where(~bad), raw.where(bad)


def normalize(raw: DataFrame) -> DataFrame:
    good, _ = split_bad(raw)
    d = common(good).withColumn("log_type", F.expr(KIND))
    numbers = {c: F.expr(f"coalesce(try_cast({c} AS {t}), 0)") for c, t in NUMBERS.items()}
    return d.withColumns({**numbers, "qtype_name": F.expr("CASE WHEN log_type = 'dns' THEN coalesce(qtype_name, 'A') END"), "ja3": F.coalesce("ja3", F.lit("")), "ja4": F.coalesce("ja4", F.lit(""))})


def rebase_time(logs: DataFrame, t0_us: int) -> DataFrame:
    """Shifts all logs alike so that the earliest record is at ``t0_us``."""
    first = logs.agg(F.min("ts_us").alias("_m"))
    return logs.crossJoin(F.broadcast(first)).withColumn("ts_us", F.col("ts_us") + (F.lit(t0_us) - F.col("_m"))).drop("_m")
