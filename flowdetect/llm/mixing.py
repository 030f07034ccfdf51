"""Mixes sources to target weights with capped repetition.

Water-filling: all sources share a budget by weight; a source whose share
exceeds ``max_epochs`` of its own size is clamped there and its excess is
shared anew among the others by weight, until no source is above its cap. The
fixed point needs no iteration: sources are clamped in order of cap / weight,
and a source is clamped when its share of what the earlier ones left exceeds
its cap.

Whole repetitions of a source take every document; for the fraction that
remains, documents are ordered by a seeded hash and taken while their running
size stays within the fraction. The running size is a prefix sum over hash
ranges, whose number follows the rows, so that no source, however large, meets in one task.

Edge cases: a null text has size 0; a null source is a source of its own, the
last. An empty table gives an empty result; with no words at all every target
and take is 0. Documents that a hash cannot tell apart (same id and text) are
taken alike up to the budget, in any order. Extra columns pass through
``mix``; ones that clash with the added names are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowdetect.llm.common import hidden, table, without

WORDS = r"[^\x20\x09-\x0D]+"
RANGE = 20_000  # rows of a range, about
ADDED = ("size", "source_size", "target", "taken")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORDS)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget_percent: int = 150, max_epochs: int = 2) -> DataFrame:
    """(source, source_size, target) from (source, size) rows. The windows run
    over the table of sources, one row each."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.row_number().over(name) - 1) % len(weights) + 1)
    per = per.withColumn("weight", pick.cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, all_ = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(all_) * budget_percent - 100 * F.coalesce(F.sum("cap").over(before), F.lit(0))
    open_ = F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumns({"left": left, "open": open_})
    # in hundredths of a word: share > cap  <=>  weight * left > 100 * cap * open
    per = per.withColumn("full", F.col("weight") * F.col("left") > 100 * F.col("cap") * F.col("open"))
    free = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.min_by(F.struct("left", "open"), F.when(~F.col("full"), F.col("cap") / F.col("weight"))).over(free)
    share = F.col("weight") * F.col("f.left") / (100.0 * F.col("f.open"))
    per = per.withColumn("f", first)
    return per.select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = (5, 2, 1), budget_percent: int = 150, max_epochs: int = 2, id_col: str = "doc_id", size: Column | None = None, digits: int | None = None) -> DataFrame:
    """Adds size, source_size, target and taken (words, repeats counted).
    ``size``: a measure other than the words of ``text``. ``digits``: of the
    hash that name a range, 16 ** digits ranges a source; else as many as keep a
    range to ``RANGE`` rows, were all of one source. The result is the same for
    any. Counts ``docs``, reads it twice and deals it out once, by source and range."""
    if digits is None:
        digits = max(2, math.ceil(math.log(max(docs.count() / RANGE, 1), 16)))
    given = without(docs, ADDED)
    z, h, b, s, sn, own = (hidden(docs, "z", "h", "b", "s", "sn", "own")[x] for x in ("z", "h", "b", "s", "sn", "own"))
    sized = docs.withColumn(z, n_words(F.col("text")) if size is None else size).select(*(F.col(f"`{c}`") for c in given), z)
    sized = sized.withColumn(h, F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))))
    sized = sized.withColumns({b: F.substring(h, 1, digits), s: F.coalesce("source", F.lit("")), sn: F.col("source").isNull()})
    # sums by source and hash range
    ranges = table(sized.groupBy(s, sn, b).agg(F.sum(z).alias("n")), "ranges")
    of = targets(ranges.select(F.when(~F.col(sn), F.col(s)).alias("source"), F.col("n").alias("size")), weights, budget_percent, max_epochs)
    of = of.select(F.coalesce("source", F.lit("")).alias(s), F.col("source").isNull().alias(sn), "source_size", "target")
    order = Window.partitionBy(s, sn).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    before, goal = hidden(docs, "before", "goal").values()
    ranges = ranges.withColumn(before, F.coalesce(F.sum("n").over(order), F.lit(0))).drop("n").join(of, [s, sn])
    ranges = ranges.select(s, sn, b, before, F.struct("source_size", "target").alias(goal))
    within = Window.partitionBy(s, sn, b).orderBy(h, z).rowsBetween(Window.unboundedPreceding, -1)
    sized = sized.withColumn(own, F.coalesce(F.sum(z).over(within), F.lit(0)))
    both = sized.join(ranges, [s, sn, b])
    of_source, target = F.col(f"{goal}.source_size"), F.col(f"{goal}.target")
    whole = F.when(of_source > 0, F.floor(target / of_source)).otherwise(F.lit(0)).cast("long")
    rest = target - whole * of_source
    # the document at the boundary is taken if at least half of it is due
    more = F.col(before) + F.col(own) + F.col(z) / 2.0 <= rest
    taken = F.col(z) * F.least(whole + more.cast("long"), F.lit(max_epochs))
    return both.select(*(F.col(f"`{c}`") for c in given), F.col(z).alias("size"), of_source.alias("source_size"), target.alias("target"), taken.alias("taken"))


def repeat(mixed: DataFrame) -> DataFrame:
    """One row per repetition that the mix takes; the columns of the input."""
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(F.lit(0)).cast("int")
    k = hidden(mixed, "k")["k"]
    rows = mixed.withColumn(k, F.explode(F.sequence(F.lit(1), F.greatest(times, F.lit(0)) + 1))).where(F.col(k) <= times)
    return rows.drop(k, *ADDED)
