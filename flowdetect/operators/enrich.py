"""Joins of encrypted sessions with byte counts and packet sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_by_uid(df: DataFrame, key: str = "uid", position: str = "event_id") -> DataFrame:
    """The last row of each key (last write wins)."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), position).alias("_r")).select(key, *(F.col(f"_r.{c}") for c in rest))


CONN = ("orig_bytes", "resp_bytes", "duration")


def join_uid(tls: DataFrame, conn: DataFrame, pktseq: DataFrame) -> DataFrame:
    """Sessions with their connection (required) and packets (if any)."""
    d = tls.join(conn.select("uid", *CONN), "uid").join(pktseq.select("uid", "sizes", "gaps"), "uid", "left")
    return d.withColumns({"sizes": F.coalesce("sizes", F.expr("cast(array() AS array<bigint>)")), "gaps": F.coalesce("gaps", F.expr("cast(array() AS array<double>)"))})


def join_uid_bounded(tls: DataFrame, conn: DataFrame, seconds: int = 30) -> DataFrame:
    """Batch twin of the stream join: a connection within ``seconds`` either
    way; sessions without one keep zero bytes."""
    c = conn.select(F.col("uid").alias("cuid"), F.col("ts_us").alias("cts"), *CONN)
    near = (F.col("uid") == F.col("cuid")) & F.col("cts").between(F.col("ts_us") - seconds * 1_000_000, F.col("ts_us") + seconds * 1_000_000)
    d = tls.join(c, near, "left").drop("cuid", "cts")
    return d.fillna({"orig_bytes": 0, "resp_bytes": 0, "duration": 0.0})
