"""Tamper-evident hash chain over alerts: one chain per ``chain_id``."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GENESIS = "0" * 64


def canonical(*columns: str) -> Column:
    """JSON with its keys in order; the stored text is what is hashed. Null
    fields are written too, so that taking one out is seen."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def append(records: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """(chain_id, pos, body) to (.., seq, prev_hash, record_hash), a fold per
    chain; chains run in parallel. ``heads``, as :func:`tail` gives them, are the
    ends of stored chains: each goes on from its own number and hash, and one
    without a head begins anew. A chain's links depend on each other, so one
    chain is one task's work, whatever the engine; it goes by in order, batch by
    batch, and no chain is held."""
    d = records.select("chain_id", "pos", "body", F.lit(1).alias("_k"), F.lit(None).cast("long").alias("_seq"), F.lit(None).cast("string").alias("_hash"))
    if heads is not None:
        none = [F.lit(None).cast(records.schema[c].dataType).alias(c) for c in ("pos", "body")]
        d = d.unionByName(heads.select("chain_id", *none, F.lit(0).alias("_k"), F.col("seq").cast("long").alias("_seq"), F.col("record_hash").alias("_hash")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, seq, last = object(), 0, GENESIS
        for b in batches:
            numbers, before, own = [], [], []
            for c, body, k, n, h in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4, 5))):
                if c != chain:
                    chain, seq, last = c, 0, GENESIS
                if not k:
                    seq, last = n + 1, h
                    continue
                numbers.append(seq)
                before.append(last)
                seq, last = seq + 1, hashlib.sha256(f"{body}|{last}".encode()).hexdigest()
                own.append(last)
            kept = [b.column(i).filter(pc.equal(b.column(3), 1)) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(numbers, pa.int64()), pa.array(before, pa.string()), pa.array(own, pa.string())], ["chain_id", "pos", "body", "seq", "prev_hash", "record_hash"])

    d = d.repartition("chain_id").sortWithinPartitions("chain_id", "_k", F.asc_nulls_last("pos"))
    return d.mapInArrow(run, "chain_id string, pos long, body string, seq long, prev_hash string, record_hash string")


def verify(chain: DataFrame) -> DataFrame:
    """Per chain: valid, total, verified, broken_at, detail. Every row checks
    its own hash and, by an equi-join on the position, its predecessor's; a
    position that occurs twice (a replayed record) breaks the chain there."""
    at = chain.groupBy("chain_id", "seq").agg(F.count("*").alias("times"), F.min("record_hash").alias("one"))
    before = at.select("chain_id", (F.col("seq") + 1).alias("seq"), F.col("one").alias("linked"))
    d = chain.join(at.drop("one"), ["chain_id", "seq"]).join(before, ["chain_id", "seq"], "left")
    detail = F.expr(
        f"CASE WHEN body IS NULL OR prev_hash IS NULL OR record_hash IS NULL THEN 'missing fields' WHEN times > 1 THEN 'repeated record' WHEN prev_hash <> coalesce(linked, '{GENESIS}') THEN 'broken link' "
        "WHEN record_hash <> sha2(concat(body, '|', prev_hash), 256) THEN 'content changed' END"
    )
    d = d.withColumn("detail", detail).groupBy("chain_id").agg(
        F.count("*").alias("total"), F.min(F.when(F.col("detail").isNotNull(), F.struct("seq", "detail"))).alias("bad"), F.min("seq").alias("s0")
    )
    return d.select("chain_id", F.col("bad").isNull().alias("valid"), "total", F.coalesce(F.col("bad.seq") - F.col("s0"), "total").alias("verified"), F.col("bad.seq").alias("broken_at"), "bad.detail")


def tail(chain: DataFrame) -> DataFrame:
    """Where each chain continues: its last well-formed record."""
    good = chain.where("record_hash rlike '^[0-9a-f]{64}$'")
    return good.groupBy("chain_id").agg(F.max("seq").alias("seq"), F.max_by("record_hash", "seq").alias("record_hash"))
