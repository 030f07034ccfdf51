"""Exact ranks and order statistics without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowdetect.sources.shared import stored


def numbered(df: DataFrame, order: list[str | Column], within: tuple[str, ...] = (), name: str = "_i", total: str | None = None, parts: int | None = None) -> DataFrame:
    """Adds ``name``, the row's number from 0 in ``order`` among the rows of equal
    ``within`` (null is a value), and ``total``, their count. Rows are sorted into
    ``parts`` ranges (else the session's shuffle partitions), written once to the
    shared folder so that the ranges stay what they are, and counted; a row's number
    is its place in its range after the counts of the ranges before. A group of any
    size is dealt to as many tasks as it fills ranges. Rows equal in ``order`` are
    numbered in any order."""
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    keys = {f"_k{i}": F.col(c) for i, c in enumerate(within)}
    d = df.repartitionByRange(parts, *keys.values(), *order).withColumn("_p", F.spark_partition_id())
    d = stored(d, "ranks")
    # a range holds one or more whole groups and at most two parts of others
    counts = d.groupBy(*(c.alias(k) for k, c in keys.items()), F.col("_p").alias("_q")).agg(F.count("*").alias("_c"))
    group = Window.partitionBy(*keys)  # as many rows as the group has ranges
    before = F.sum("_c").over(group.orderBy("_q").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumns({"_o": F.coalesce(before, F.lit(0)), "_t": F.sum("_c").over(group)}).drop("_c")
    d = d.withColumn(name, F.row_number().over(Window.partitionBy(*keys.values(), "_p").orderBy(*order)) - 1)
    same = [F.col("_p") == F.col("_q"), *(c.eqNullSafe(F.col(k)) for k, c in keys.items())]
    both = d.join(counts, same).withColumn(name, F.col(name) + F.col("_o"))
    if total:
        both = both.withColumn(total, F.col("_t"))
    return both.drop("_p", "_q", "_o", "_t", *keys)


def order_statistic(df: DataFrame, value: str, k: int, splits: int = 64, few: int = 100_000):
    """The value that ``k`` (from 0) of the values that are not null come before;
    None if there are not so many. While more than ``few`` are left, they are cut
    at ``splits`` quantiles of what is left and counted; those between the two
    cuts around the rank stay, so values of any distribution shrink alike. A round
    brings the cuts and their counts to the driver, no values."""
    left = df.where(F.col(value).isNotNull()).select(F.col(value).alias("v"))
    n = left.count()
    if not 0 <= k < n:
        return None
    while n > few:
        shares = F.array(*(F.lit(i / splits) for i in range(splits + 1)))
        cuts = sorted(set(left.agg(F.percentile_approx("v", shares, 10_000)).first()[0]), key=lambda c: (c != c, c))  # NaN last, as Spark has it
        at = F.array(*(F.lit(c) for c in cuts)).cast(f"array<{left.schema['v'].dataType.simpleString()}>")
        # 2 i + 1: equal to cut i; 2 i: between cuts i - 1 and i
        place = F.size(F.filter(at, lambda c: c < F.col("v"))) * 2 + F.array_contains(at, F.col("v")).cast("int")
        for p, c in sorted(left.groupBy(place.alias("p")).count().collect()):
            if k < c:
                break
            k -= c
        if p % 2:
            return cuts[p // 2]
        i, n = p // 2, c
        if i > 0:
            left = left.where(F.col("v") > at[i - 1])
        if i < len(cuts):
            left = left.where(F.col("v") < at[i])
    freq = left.groupBy("v").count()
    upto = F.sum("count").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    return freq.withColumn("c", upto).where(f"c > {k}").agg(F.min("v")).first()[0]
