from pyspark.sql import functions as F

from flowdetect.operators import dataset, detect, ml
from flowdetect.plans import q_data

SF = "/root/testdata/sf0.001"
S = 1_000_000


def test_lexical_rows_have_the_eight_features(spark):
    corpus = spark.createDataFrame([("the secure login page, the login",)], "text string")
    d = spark.createDataFrame([("a", "securelogin.Example.COM"), ("b", "xq7zk.ru"), ("c", "login")], "uid string, query string")
    got = {r.uid: r for r in dataset.lexical_rows(d, "query", corpus).collect()}
    assert len(dataset.LEXICAL) == 8 and set(dataset.LEXICAL) <= set(got["a"].asDict())
    assert [(got[k].word_boundary_score, got[k].known_tld, got[k].label_n, got[k].numeric_ratio) for k in "abc"] == [(1.0, 1, 11, 0.0), (0.0, 0, 5, 0.2), (1.0, 0, 5, 0.0)]
    assert got["a"].ngram_score > got["b"].ngram_score == -10


def test_dga_path_cooldown_and_tunnel_rows(spark):
    rows = [("u1", 0, "q.ru", 0.9, 0.0), ("u2", 299 * S, "q.ru", 0.9, 0.0), ("u3", 300 * S, "q.ru", 0.8, 0.7), ("u4", 0, "t.ru", 0.9, 0.0), ("u5", 0, "r.ru", 0.7, 0.0)]
    scored = spark.createDataFrame([(*r, "10.0.0.1") for r in rows], "uid string, ts_us long, query string, p double, word_boundary_score double, src_ip string")
    got = detect.dga_ml(scored, spark.createDataFrame([("u4",)], "uid string")).withColumn("path", F.get_json_object("evidence_json", "$.detection_path"))
    assert sorted((r.flow_id, r.severity, r.path) for r in got.collect()) == [("u1", "HIGH", "RANDOM_DGA"), ("u3", "MEDIUM", "DICT_DGA")]


def test_flood_and_scan_models_alert_once_in_their_cooldown(spark):
    times = [0, 10, 20, 29, 30, 45]
    scored = spark.createDataFrame([(i, f"C{i}", t * S, "10.0.0.1", "b", 80, 0.9, 700, 40) for i, t in enumerate(times)], "event_id long, uid string, ts_us long, src_ip string, dst_ip string, dst_port int, p double, packet_rate int, unique_ports int")
    assert sorted(r.event_ts for r in detect.flood_ml(scored).collect()) == [0, 30]
    assert sorted(r.event_ts for r in detect.scan_ml(scored).collect()) == [0, 20, 45]


def test_forest_is_the_reference_one(spark):
    rows = spark.range(200).selectExpr("cast(id AS double) AS v", "cast(id >= 190 AS int) AS y")
    model = q_data.forest(rows, ["v"]).stages[-1]
    assert model.getNumTrees == 200 and model.getOrDefault("maxDepth") == 6 and model.getOrDefault("weightCol") == "w"
    weighted = ml.class_weight(rows)
    assert ml.train_gbt(weighted, ["v"], rounds=2, weight="w").stages[-1].getOrDefault("weightCol") == ml.train_logistic(weighted, ["v"], "w").stages[-1].getOrDefault("weightCol") == "w"


def test_held_out_scores_come_from_models_that_met_no_row_of_the_fold(spark):
    rows = ml.packed_folds(spark.range(60).selectExpr("id", "id DIV 7 AS grp", "cast(id % 2 AS int) AS y"), "grp", 3)
    fold_of = {r.id: r.fold for r in rows.collect()}
    met = {}

    def train(fit, features):
        known = {r.id for r in fit.select("id").collect()}

        def model(held):
            for r in held.select("id").collect():
                met[r.id] = known
            return held.withColumn("p", F.col("y") * 0.8)

        return model

    got = ml.out_of_fold(rows, [], "fold", 3, train).collect()
    assert sorted(r.id for r in got) == list(range(60)) and {r.p for r in got} == {0.0, 0.8}
    assert all(known == {j for j in range(60) if fold_of[j] != fold_of[i]} for i, known in met.items()) and len(met) == 60
    report = ml.compare(rows, [], "fold", 3, {"given": train}).first()
    assert (report["model"], report["tp"], report["fp"], report["tn"], report["fn"]) == ("given", 30, 0, 30, 0)


def test_calibration_is_fitted_on_its_own_groups(spark):
    rows = ml.group_split(spark.range(400).selectExpr("id", "concat('g', id % 40) AS grp", "id % 100 / 100D AS p", "cast(id % 100 > 60 AS int) AS y"), "grp")
    parts = {r.split for r in rows.select("split").distinct().collect()}
    assert parts == {"test", "cal", "fit"}
    got = ml.calibrate(ml.platt(rows.where("split = 'cal'")), rows).where("split = 'test'")
    assert got.where("(calibrated > 0.5) <> (y = 1)").count() <= got.count() // 10


def test_rows_alike_are_trained_on_together(spark, monkeypatch):
    monkeypatch.setattr(ml, "MANY", 1000)
    monkeypatch.setattr(ml, "TOGETHER", 3)
    rows = spark.range(6000).selectExpr("id", "cast(id * 37 % 101 AS int) AS a", "id * 17 % 5 / 7D AS b", "1.5D AS c", "cast((id * 37 % 101 > 60) <> (id % 10 = 0) AS int) AS y")
    rows = rows.where("y = 1 OR id % 3 = 0")
    forest = q_data.forest(rows, ["a", "b", "c"], 8, 4)
    assert isinstance(forest, ml.Cells) and len(forest.trees) == 8
    plain = ml.score(ml.train_rf(ml.class_weight(rows), ["a", "b", "c"], 200, 4, "w"), rows).select("id", F.col("p").alias("q"))
    got = ml.score(forest, rows)
    assert got.columns == [*rows.columns, "p"]
    both = got.join(plain, "id").selectExpr("count(*) AS n", "avg(abs(p - q)) AS far", "avg(int((p > 0.5) = (q > 0.5))) AS same").first()
    assert both.n == rows.count() and both.far < 0.08 and both.same > 0.95
    assert abs(sum(forest.importances()) - 1) < 1e-9 and max(forest.importances()) == forest.importances()[0]
    monkeypatch.setattr(ml, "COPIES", 1000)  # seldom alike
    assert q_data.forest(rows, ["a", "b", "c"], 8, 4).stages[-1].getNumTrees == 8


def test_a_cell_is_drawn_as_often_as_its_rows(spark):
    cells = spark.range(1, 401).selectExpr("id AS _b0", "id % 40 AS _n").repartition(2, "_b0").sortWithinPartitions("_b0")
    first, again = (ml._drawn(cells, 50).orderBy("_b0").collect() for _ in range(2))
    assert first == again
    off = [(r[f"_c{i}"] - r["_n"]) / max(r["_n"], 1) ** 0.5 for r in first for i in range(50)]
    assert abs(sum(off) / len(off)) < 0.03 and abs(sum(o * o for o in off) / len(off) - 39 / 40) < 0.05  # mean and variance n
    assert all(r[f"_c{i}"] == 0 for r in first if r["_n"] == 0 for i in range(50))


def test_scans_train_on_cells_too(spark, monkeypatch):
    monkeypatch.setattr(ml, "MANY", 500)
    monkeypatch.setattr(ml, "COPIES", 1)
    monkeypatch.setattr(q_data, "forest", lambda rows, f: made.append(ml.train_forest(ml.class_weight(rows), f, 4, 3, "w")) or made[-1])
    made = []
    rows = q_data.Q["dt5_scan_ml"](spark, SF)
    assert isinstance(made[0], ml.Cells) and len(made[0].trees) == 4
    assert rows.count() > 0 and rows.where("confidence <= 0.5 OR confidence IS NULL").count() == 0
