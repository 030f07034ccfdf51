"""Evaluation, weights, folds and splits in SQL; training with MLlib."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from multiprocessing.pool import ThreadPool
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowdetect.operators import ranks
from flowdetect.sources.shared import stored


def _rates(d: DataFrame) -> DataFrame:
    d = d.selectExpr("*", "round(tp / nullif(tp + fp, 0), 4) AS precision", "round(tp / nullif(tp + fn, 0), 4) AS recall", "round(fp / nullif(fp + tn, 0), 4) AS fpr", "round(fn / nullif(fn + tp, 0), 4) AS fnr", "round((tp + tn) / nullif(tp + tn + fp + fn, 0), 4) AS accuracy")
    return d.selectExpr("*", "round(2 * precision * recall / nullif(precision + recall, 0), 4) AS f1")


def confusion(rows: DataFrame, y: str = "y", pred: str = "pred", by: tuple[str, ...] = ()) -> DataFrame:
    """tp, fp, tn, fn and rates; F1 from the rounded precision and recall."""
    n = {k: F.count_if(F.expr(f"{y} = {a} AND {pred} = {b}")).alias(k) for k, a, b in (("tp", 1, 1), ("fp", 0, 1), ("tn", 0, 0), ("fn", 1, 0))}
    return _rates(rows.groupBy(*by).agg(*n.values()))


def recall_by(rows: DataFrame, group: str) -> DataFrame:
    return rows.where("y = 1").groupBy(group).agg(F.round(F.avg((F.col("pred") == 1).cast("int")), 4).alias("recall"))


def class_report(rows: DataFrame) -> DataFrame:
    """Precision, recall, F1 of each label value."""
    both = rows.selectExpr("explode(array(named_struct('label', y, 't', 1, 'p', cast(y = pred AS int), 'q', 0), named_struct('label', pred, 't', 0, 'p', 0, 'q', 1))) AS r").select("r.*")
    d = both.groupBy("label").agg(F.sum("p").alias("hit"), F.sum("t").alias("support"), F.sum("q").alias("said"))
    return d.selectExpr("label", "support", "round(hit / nullif(said, 0), 4) AS precision", "round(hit / nullif(support, 0), 4) AS recall", "round(2 * hit / nullif(said + support, 0), 4) AS f1")


def blind_spot(rows: DataFrame, condition: str) -> DataFrame:
    return rows.where(condition).groupBy("label").count()


def reliability(rows: DataFrame, p: str = "p", y: str = "y", bins: int = 10) -> DataFrame:
    return rows.groupBy(F.expr(f"cast(least({bins - 1}, floor({p} * {bins})) AS bigint)").alias("bin")).agg(F.round(F.avg(p), 6).alias("predicted"), F.round(F.avg(y), 6).alias("observed"))


def confidence_shift(rows: DataFrame, base: str, calibrated: str) -> DataFrame:
    s = F.max(F.abs(F.col(base) - F.col(calibrated)))
    return rows.agg(F.round(s, 6).alias("shift"), (s > 0.15).alias("warn"))


def class_weight(rows: DataFrame, y: str = "y") -> DataFrame:
    """Adds w = n / (classes * n_c)."""
    per = rows.groupBy(y).agg(F.count("*").alias("_c"))
    all_ = per.agg(F.sum("_c").alias("_n"), F.count("*").alias("_k"))
    return rows.join(F.broadcast(per), y).crossJoin(F.broadcast(all_)).withColumn("w", F.col("_n") / (F.col("_k") * F.col("_c"))).drop("_c", "_n", "_k")


def row_weight(rows: DataFrame, column: str, value: str, factor: float = 10.0) -> DataFrame:
    return rows.withColumn("w", F.col("w") * F.when(F.col(column) == value, factor).otherwise(1.0))


def group_folds(rows: DataFrame, group: str, k: int = 10) -> DataFrame:
    """Folds balanced by rows: groups by falling size, dealt there and back."""
    size = rows.groupBy(group).agg(F.count("*").alias("_n"))
    i = F.col("_i")
    fold = F.when((F.floor(i / k) % 2) == 0, i % k).otherwise(k - 1 - i % k)
    size = ranks.numbered(size, [F.desc("_n"), group]).select(F.col(group).alias("_g"), fold.cast("long").alias("fold"))
    return rows.join(size, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def _packed(sizes: list[tuple[int, int]], k: int) -> list[tuple[int, list[int]]]:
    """Greedy packing, largest first, of ``c`` groups of each size ``s`` into k
    folds: how many of each size the folds 0 .. i take. The c groups of one size
    go to the c least of all ``load + j * s`` (ties: the first fold), so a class
    is placed at once, by bisection of the load they fill up to."""
    loads, out = [0] * k, []
    for s, c in sorted(sizes, reverse=True):
        below = lambda t: [max(0, -((load - t) // s)) for load in loads]  # noqa: E731, B023
        low, high = min(loads), max(loads) + s * c + 1  # places with a load below t: at most c at low, c or more at high
        while low + 1 < high:
            mid = (low + high) // 2
            low, high = (mid, high) if sum(below(mid)) <= c else (low, mid)
        took = below(low)
        for f in range(k):  # the rest stands at the load itself
            if sum(took) < c and loads[f] + took[f] * s == low:
                took[f] += 1
        loads = [load + t * s for load, t in zip(loads, took)]
        out.append((s, [sum(took[: f + 1]) for f in range(k)]))
    return out


def packed_folds(rows: DataFrame, group: str, k: int = 10) -> DataFrame:
    """Adds fold: each group, largest first, goes to the fold with the fewest
    rows. Groups of one size are alike, so only the sizes and how many groups
    have each come to the driver (n rows have at most sqrt(2 n) sizes); which of
    them a fold takes is settled by their numbers within the size."""
    size = rows.groupBy(group).agg(F.count("*").alias("_n"))
    counted = [(r["_n"], r["c"]) for r in size.groupBy("_n").agg(F.count("*").alias("c")).collect()]
    plan = rows.sparkSession.createDataFrame(_packed(counted, k), "_n long, _upto array<long>")
    d = ranks.numbered(size, [group], ("_n",)).join(plan, "_n")
    d = d.select(F.col(group).alias("_g"), F.expr("cast(size(filter(_upto, u -> u <= _i)) AS bigint)").alias("fold"))
    return rows.join(d, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def hash_folds(rows: DataFrame, group: str, k: int = 10) -> DataFrame:
    return rows.withColumn("fold", F.expr(f"pmod(xxhash64({group}), {k})"))


def group_split(rows: DataFrame, group: str, seed: int = 42, pinned: tuple[str, ...] = ()) -> DataFrame:
    """Adds split: test 20 %, cal 25 % of the rest, fit; by groups, pinned ones
    in fit."""
    u = F.expr(f"conv(substr(md5(concat({seed}, ':', {group})), 1, 8), 16, 10) % 10000 / 10000D")
    s = F.when(F.col(group).isin(*pinned), "fit") if pinned else F.when(F.lit(False), "")
    return rows.withColumn("split", s.when(u < 0.2, "test").when(u < 0.4, "cal").otherwise("fit"))


def stratified_split(rows: DataFrame, y: str, key: str, test: float = 0.2) -> DataFrame:
    """Exact share per label, in the order of a hash."""
    d = ranks.numbered(rows, [F.md5(F.col(key).cast("string")), key], (y,), "_r", "_n")
    return d.withColumn("split", F.expr(f"if(_r < round(_n * {test}), 'test', 'train')")).drop("_r", "_n")


def select_threshold(rows: DataFrame, floor: float = 0.9, p: str = "p", y: str = "y") -> DataFrame:
    """The threshold of .01 .. .99 with the best recall at a precision of at
    least ``floor`` (the lowest of equals), else .5. Rows are counted by
    hundredths first."""
    cells = rows.groupBy(F.expr(f"cast(floor(round({p} * 100, 6)) AS int)").alias("c")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.count("*").alias("n"))
    t = rows.sparkSession.range(1, 100).selectExpr("cast(id AS int) AS t")
    d = F.broadcast(t).join(cells).groupBy("t").agg(F.sum(F.expr("if(c >= t, pos, 0)")).alias("tp"), F.sum(F.expr("if(c >= t, n, 0)")).alias("said"), F.sum("pos").alias("all"))
    ok = d.where(f"said > 0 AND tp >= {floor} * said")
    best = ok.agg(F.max_by("t", F.struct("tp", -F.col("t"))).alias("b"))
    return best.select((F.coalesce("b", F.lit(50)) / 100).alias("threshold"))


RULES = {"ddos": "packet_rate > 200", "recon": "unique_ports > 15 OR unique_hosts > 10", "c2": "observations >= 5 AND mean_interval BETWEEN 3 AND 600 AND cv <= 0.35"}


def rule_baseline(rows: DataFrame, detector: str) -> DataFrame:
    return rows.withColumn("pred", F.expr(f"cast(coalesce({RULES[detector]}, false) AS int)"))


def _pipeline(features: list[str], classifier, scale: bool = False) -> Pipeline:
    stages = [VectorAssembler(inputCols=features, outputCol="_v")]
    if scale:
        stages.append(StandardScaler(inputCol="_v", outputCol="_z", withMean=True))
    return Pipeline(stages=[*stages, classifier.setFeaturesCol("_z" if scale else "_v").setLabelCol("y")])


TRAINED = 50_000  # rows of a forest's partition: each is kept with a count for each tree, 0.8 KB for 200


ROUNDS = 200_000  # rows of a partition of rounds: a row is kept with one count, and a round of few rows is all start-up


def _dealt(rows: DataFrame, features: list[str], weight: str | None, each: int | None = None) -> DataFrame:
    """What training reads, in partitions of ``TRAINED`` rows and not of so many
    bytes of the files, of which a row takes far fewer than in training; or of
    ``each`` rows, however few partitions that makes."""
    d = rows.select("y", *features, *([weight] if weight else []))
    return d.repartition(max(1, -(-rows.count() // (each or TRAINED)), 1 if each else rows.sparkSession.sparkContext.defaultParallelism))


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` of a stored table in ``TRAINED`` to a partition at most, one for
    each core at least: a table of few files would be scored in as few tasks."""
    parts = max(-(-rows.count() // TRAINED), rows.sparkSession.sparkContext.defaultParallelism)
    return rows if rows.rdd.getNumPartitions() >= parts else rows.repartition(parts)


def train_rf(rows: DataFrame, features: list[str], trees: int = 200, depth: int = 6, weight: str | None = None):
    c = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=42)
    return _pipeline(features, c.setWeightCol(weight) if weight else c).fit(_dealt(rows, features, weight))


MANY = 1_000_000  # rows from which a forest is fitted to cells of like ones
COPIES = 4  # rows a cell, on average, without which it is not
BINS = 32  # as many as the forest's own (maxBins)
TOGETHER = 10  # trees that score in one pass


def train_forest(rows: DataFrame, features: list[str], trees: int = 200, depth: int = 6, weight: str | None = None):
    """A forest over a stored table. MLlib visits every row for each tree and
    level. Of ``MANY`` rows or more, those that no split tells apart are one cell:
    of each label, 31 quantiles of a feature (or all its values, if few) cut it,
    between which MLlib chooses its own cuts. A tree draws each of a cell's n rows
    Poisson(1) times, so the cell Poisson(n) times, and is fitted to the cells with
    these counts: the same bootstrap of all rows, for as much work as there are
    cells. Rows that are seldom alike are trained on as they are."""
    n = rows.count()
    if n < MANY:
        return train_rf(rows, features, trees, depth, weight)
    buckets = _buckets(rows, features)
    cols = buckets.getOutputCols()
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    cells = stored(buckets.transform(rows).groupBy(*cols, "y", w.alias("_w")).agg(F.count("*").alias("_n")), "cells")
    found = cells.count()
    if found * COPIES > n:
        return train_rf(rows, features, trees, depth, weight)
    drawn = _drawn(cells.repartition(-(-found // TRAINED), *cols, "y", "_w").sortWithinPartitions(*cols, "y", "_w"), trees).persist()
    drawn.count()

    y = F.col("y").alias("y", metadata={"ml_attr": {"type": "nominal", "num_vals": 2}})  # whatever a tree draws

    def fit(i: int):
        own = drawn.where(f"_c{i} > 0").select(y, *cols, (F.col("_w") * F.col(f"_c{i}")).alias("_w"))
        c = RandomForestClassifier(numTrees=1, bootstrap=False, featureSubsetStrategy="sqrt", maxDepth=depth, seed=42 + i, weightCol="_w")
        return _pipeline(cols, c).fit(own).stages[-1]

    with ThreadPool(min(trees, rows.sparkSession.sparkContext.defaultParallelism)) as pool:
        fitted = pool.map(inheritable_thread_target(rows.sparkSession)(fit), range(trees), 1)
    drawn.unpersist()
    return Cells(buckets, fitted)


def _buckets(rows: DataFrame, features: list[str]) -> Bucketizer:
    at = [i / BINS for i in range(1, BINS)]
    labels = [r["y"] for r in rows.select("y").distinct().collect()]
    quantiles = [rows.where(F.col("y") == y).approxQuantile(features, at, 0.002) for y in labels]
    cuts = []
    for i, f in enumerate(features):
        few = [float(r[0]) for r in rows.select(f).distinct().limit(BINS + 1).collect()]
        cuts.append(sorted(set(few))[1:] if len(few) <= BINS else sorted({v for q in quantiles for v in q[i]}))
    inf = float("inf")
    cuts = [[c for c in own if -inf < c < inf] or [0.0] for own in cuts]  # a constant needs a cut too
    return Bucketizer(splitsArray=[[-inf, *own, inf] for own in cuts], inputCols=features, outputCols=[f"_b{i}" for i in range(len(features))])


def _drawn(cells: DataFrame, trees: int) -> DataFrame:
    """Adds _c0, _c1 ...: how often each tree draws the cell's rows. The cells
    are sorted, so a task that runs again draws the same."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([42, TaskContext.get().partitionId()])
        for batch in batches:
            n = batch["_n"].to_numpy()
            counts = [pa.array(rng.poisson(n), pa.int64()) for _ in range(trees)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *counts], names=[*batch.schema.names, *(f"_c{i}" for i in range(trees))])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema)
    return cells.mapInArrow(draw, ", ".join([kinds, *(f"_c{i} long" for i in range(trees))]))


class Cells:
    """A forest of trees fitted to cells: a function that adds ``p``. Every cell
    is scored once, ``TOGETHER`` trees at a time; rows take the score of theirs."""

    def __init__(self, buckets: Bucketizer, trees: list):
        self.buckets, self.trees = buckets, trees

    def _scored(self, cells: DataFrame) -> DataFrame:
        cols = self.buckets.getOutputCols()
        cells = stored(VectorAssembler(inputCols=cols, outputCol="_v").transform(cells), "vectors")
        parts = []
        for i in range(0, len(self.trees), TOGETHER):
            d, own = cells, self.trees[i : i + TOGETHER]
            for j, tree in enumerate(own):
                d = tree.setPredictionCol("").setRawPredictionCol("").setProbabilityCol(f"_p{j}").transform(d)
            votes = reduce(add, (vector_to_array(f"_p{j}")[1] for j in range(len(own))))
            parts.append(d.select(*cols, votes.cast("decimal(20,14)").alias("_s")))
        mean = F.sum("_s").cast("double") / len(self.trees)
        return stored(reduce(DataFrame.unionByName, parts).groupBy(*cols).agg(mean.alias("p")), "scored")

    def __call__(self, rows: DataFrame) -> DataFrame:
        cols = self.buckets.getOutputCols()
        d = self.buckets.transform(rows)
        return d.join(self._scored(d.select(*cols).distinct()), cols).drop(*cols)

    def importances(self) -> list[float]:
        own = sum(tree.featureImportances.toArray() for tree in self.trees)
        return (own / max(own.sum(), 1e-300)).tolist()


def train_logistic(rows: DataFrame, features: list[str], weight: str | None = None):
    c = LogisticRegression()
    return _pipeline(features, c.setWeightCol(weight) if weight else c, scale=True).fit(_dealt(rows, features, weight, ROUNDS))


def train_gbt(rows: DataFrame, features: list[str], rounds: int = 150, depth: int = 4, weight: str | None = None):
    """Boosted trees over a stored table. MLlib visits every row in each round and
    level. The rows of a cell (see :func:`train_forest`) have the same residual in
    every round, and none are drawn, so ``MANY`` rows or more are fitted to cells
    with the sums of their weights; rows that are seldom alike as they are."""
    c = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=42)
    n = rows.count()
    if n >= MANY:
        buckets = _buckets(rows, features)
        cols = buckets.getOutputCols()
        cells = buckets.transform(rows).groupBy(*cols, "y").agg(F.sum(F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("_w"))
        cells = stored(cells, "cells")
        found = cells.count()
        if found * COPIES <= n:
            cells = cells.select("y", *(F.col(b).alias(b, metadata={}) for b in cols), "_w")  # else categories
            cells = cells.repartition(-(-found // ROUNDS), *cols, "y").sortWithinPartitions(*cols, "y")
            return PipelineModel([buckets, *_pipeline(cols, c.setWeightCol("_w")).fit(cells).stages])
    return _pipeline(features, c.setWeightCol(weight) if weight else c).fit(_dealt(rows, features, weight, ROUNDS))


def score(model, rows: DataFrame, out: str = "p") -> DataFrame:
    if isinstance(model, Cells):
        return model(rows).withColumnRenamed("p", out)
    d = model.transform(rows)
    cut = model.stages[0].getOutputCols() if isinstance(model.stages[0], Bucketizer) else []
    return d.withColumn(out, vector_to_array("probability")[1]).drop(*cut, "_v", "_z", "probability", "rawPrediction", "prediction")


def _with_score(model, rows: DataFrame) -> DataFrame:
    return score(model, rows) if hasattr(model, "transform") else model(rows)


def evaluate_unseen(rows: DataFrame, unseen: DataFrame, score_with, threshold: float = 0.5) -> DataFrame:
    """Confusion over the rows of groups (``unseen``: grp) that no training,
    fold or threshold has met. ``score_with``: adds the column p."""
    held = score_with(rows.join(unseen, "grp", "left_semi"))
    return confusion(held.selectExpr("y", f"cast(p > {threshold} AS int) AS pred"))


def out_of_fold(rows: DataFrame, features: list[str], fold: str, k: int, train, parallel: int = 4) -> DataFrame:
    """Every row of the folds 0 .. k - 1 with the score ``p`` of a model that met
    no row of its fold. ``train`` gives a model, or a function that adds ``p``;
    ``parallel`` folds train at a time."""

    def held(i: int) -> DataFrame:
        return _with_score(train(rows.where(f"{fold} <> {i}"), features), rows.where(f"{fold} = {i}"))

    with ThreadPool(min(parallel, k)) as pool:
        return reduce(DataFrame.unionByName, pool.map(inheritable_thread_target(rows.sparkSession)(held), range(k)))


def compare(rows: DataFrame, features: list[str], fold: str, k: int, trainers: dict, parallel: int = 4, light: tuple[str, ...] = ()) -> DataFrame:
    """Pooled confusion of every trainer over the folds' held-out rows (see
    :func:`out_of_fold`). Every fit of every fold passes over ``rows``: give a
    stored table. Of the ``light`` trainers, which hold little for a row and wait
    for one small job after another, all folds train at a time."""
    parts = [out_of_fold(rows, features, fold, k, train, k if name in light else parallel).select(F.lit(name).alias("model"), "y", F.expr("cast(p > 0.5 AS int)").alias("pred")) for name, train in trainers.items()]
    return confusion(reduce(DataFrame.unionByName, parts), by=("model",))


def platt(cal: DataFrame, p: str = "p"):
    """Sigmoid of a * p + b, fitted on the calibration rows."""
    v = VectorAssembler(inputCols=[p], outputCol="_s")
    return Pipeline(stages=[v, LogisticRegression(featuresCol="_s", labelCol="y", regParam=0.0)]).fit(cal)


def calibrate(model, rows: DataFrame, out: str = "calibrated") -> DataFrame:
    return model.transform(rows).withColumn(out, vector_to_array("probability")[1]).drop("_s", "probability", "rawPrediction", "prediction")


def importances(model, features: list[str], spark) -> DataFrame:
    values = model.importances() if isinstance(model, Cells) else model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(features, values)), "feature string, importance double").orderBy(F.desc("importance"), "feature")


def contributions(rows: DataFrame, features: list[str], importance: dict[str, float]) -> DataFrame:
    """Adds feature_contributions, by falling importance."""
    items = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"), F.lit(round(importance.get(f, 0.0), 4)).alias("importance")) for f in sorted(features, key=lambda f: -importance.get(f, 0.0))))
    return rows.withColumn("feature_contributions", items)


def train_sequence(rows: DataFrame, layers: tuple[int, ...] = (36, 32, 16, 2)):
    v = rows.withColumn("features", array_to_vector(F.concat("seq_sizes", "seq_gaps", "seq_mask")))
    return MultilayerPerceptronClassifier(layers=list(layers), featuresCol="features", labelCol="y", seed=42, maxIter=50).fit(v)


def score_sequence(model, rows: DataFrame, out: str = "p2") -> DataFrame:
    v = rows.withColumn("features", array_to_vector(F.concat("seq_sizes", "seq_gaps", "seq_mask")))
    return model.transform(v).withColumn(out, vector_to_array("probability")[1]).drop("features", "probability", "rawPrediction", "prediction")


def save(model, path: str, calibration: DataFrame | None = None) -> None:
    model.write().overwrite().save(path)
    if calibration is not None:
        calibration.write.mode("overwrite").parquet(f"{path}-calibration")


def save_metrics(metrics: DataFrame, path: str) -> None:
    metrics.coalesce(1).write.mode("overwrite").json(path)
