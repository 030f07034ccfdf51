"""Character language models over words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trigrams(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row per sliding alphabetic 3-gram of the lower-cased text. The text is
    passed over once: taking out each place by its number would start anew from
    the front for every one of a long text."""
    return df.select(*keep, F.explode(F.regexp_extract_all(F.lower(text), F.lit("(?=([a-z]{3}))"), 1)).alias("gram"))


def letter_runs(df: DataFrame, text: str) -> DataFrame:
    """run, c: the distinct runs of three or more letters and how often each stands."""
    return df.select(F.explode(F.split(F.lower(text), "[^a-z]+")).alias("run")).where("length(run) >= 3").groupBy("run").agg(F.count("*").alias("c"))


def trigram_model(df: DataFrame, text: str) -> DataFrame:
    """gram, log2 of its share, four digits. No 3-gram crosses a run of letters,
    so equal runs are counted first and taken apart once."""
    return trigram_model_of(letter_runs(df, text))


def trigram_model_of(runs: DataFrame) -> DataFrame:
    n = trigrams(runs, "run", "c").groupBy("gram").agg(F.sum("c").alias("n"))
    return n.crossJoin(n.agg(F.sum("n").alias("total"))).select("gram", F.expr("round(log2(n / total), 4)").alias("logp"))


def ngram_score(df: DataFrame, key: str, text: str, model: DataFrame) -> DataFrame:
    """Mean log share of the text's 3-grams; unknown ones and none count -10. The
    model, 26 ** 3 rows at most, goes to the texts: a common 3-gram fills no task."""
    s = trigrams(df, text, key).join(F.broadcast(model), "gram", "left").groupBy(key).agg(F.avg(F.coalesce("logp", F.lit(-10.0))).alias("s"))
    return df.select(key).join(s, key, "left").select(key, F.round(F.coalesce("s", F.lit(-10.0)), 9).alias("ngram_score"))


def words(df: DataFrame, text: str, low: int = 3, high: int = 10) -> DataFrame:
    """Distinct lower-case alphabetic words of a length."""
    w = df.select(F.explode(F.split(F.lower(F.trim(text)), r"[^a-z]+")).alias("word"))
    return w.where(F.length("word").between(low, high)).distinct()


def word_boundary_score(df: DataFrame, key: str, label: str, lexicon: DataFrame, longest: int = 12) -> DataFrame:
    """Share of the label that greedy longest-match words cover: candidates
    (position, length) are joined with the lexicon, then folded left to right."""
    cand = df.select(key, F.col(label).alias("_l")).withColumn("p", F.explode(F.expr("sequence(1, greatest(length(_l), 1))")))
    cand = cand.withColumn("n", F.explode(F.expr(f"sequence(3, {longest})"))).where("p + n - 1 <= length(_l)")
    hit = cand.withColumn("word", F.expr("lower(substr(_l, p, n))")).join(lexicon.select("word"), "word", "left_semi")
    best = hit.groupBy(key, "p").agg(F.max("n").alias("n")).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("p", "n"))).alias("a"))
    fold = "aggregate(a, named_struct('at', 1, 'sum', 0), (s, e) -> if(e.p >= s.at, named_struct('at', e.p + e.n, 'sum', s.sum + e.n), s)).sum"
    got = best.select(key, F.expr(fold).alias("m"))
    return df.select(key, F.length(label).alias("_n")).join(got, key, "left").select(key, F.round(F.coalesce("m", F.lit(0)) / F.greatest("_n", F.lit(1)), 4).alias("wbs"))
