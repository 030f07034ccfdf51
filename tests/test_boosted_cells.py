from pyspark.ml.feature import Bucketizer
from pyspark.sql import functions as F

from flowdetect.operators import ml
from flowdetect.sources.shared import stored


def rows_of(spark):
    d = spark.range(6000).selectExpr("id", "cast(xxhash64(id) % 7 AS double) AS a", "cast(xxhash64(id, 1) % 5 AS double) AS b", "xxhash64(id, 2) % 100 AS c")
    return d.selectExpr("id", "a", "b", "cast(a * b + c % 3 > 2 AS int) AS y").repartition(3)


def test_boosted_trees_of_many_rows_are_fitted_to_cells(spark, monkeypatch):
    rows = stored(rows_of(spark), "boosted")
    weighted = ml.class_weight(rows)
    plain = ml.score(ml.train_gbt(weighted, ["a", "b"], 5, 3, "w"), rows).select("id", F.col("p").alias("q"))
    monkeypatch.setattr(ml, "MANY", 1000)
    dealt = []
    monkeypatch.setattr(ml, "_dealt", lambda *a: dealt.append(a))  # what trains on rows
    model = ml.train_gbt(weighted, ["a", "b"], 5, 3, "w")
    assert not dealt and isinstance(model.stages[0], Bucketizer)
    got = ml.score(model, rows)
    assert set(got.columns) == {*rows.columns, "p"}
    both = got.join(plain, "id")
    assert both.count() == 6000 and both.where("abs(p - q) > 1e-6").count() == 0


def test_boosted_trees_of_rows_seldom_alike_are_fitted_to_rows(spark, monkeypatch):
    rows = stored(spark.range(1200).selectExpr("rand(1) AS a", "rand(2) AS b", "rand(3) AS c", "cast(id % 2 AS int) AS y"), "seldom")
    monkeypatch.setattr(ml, "MANY", 1000)
    model = ml.train_gbt(rows, ["a", "b", "c"], 2, 2)
    assert not isinstance(model.stages[0], Bucketizer)
