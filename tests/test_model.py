import numpy as np
import pytest
from pyspark.sql import functions as F

from homescore.config import ForestParams, ModelFamilies, RecommendationRules
from homescore.operators import model
from tests.conftest import rows


def test_metrics_by_hand(spark):
    data = [(1, 1.0)] * 3 + [(1, 0.0)] + [(0, 1.0)] * 2 + [(0, 0.0)] * 4
    df = spark.createDataFrame(data, "enhance_flag int, prediction double")
    got = {r["label"]: r for r in model.classification_metrics(df).collect()}
    assert got[1]["precision"] == pytest.approx(3 / 5) and got[1]["recall"] == pytest.approx(3 / 4)
    assert got[0]["support"] == 6 and got[0]["accuracy"] == pytest.approx(0.7)
    assert rows(model.confusion(df)) == [(0, 0, 4), (0, 1, 2), (1, 0, 1), (1, 1, 3)]


def test_split_depends_on_the_key_only(spark):
    keys = spark.range(2000).select(F.col("id").cast("string").alias("serial_num"))
    first = rows(model.with_split(keys.repartition(7)))
    assert first == rows(model.with_split(keys.orderBy(F.desc("serial_num"))))
    assert 0.15 < np.mean([t for _, t in first]) < 0.25


def test_class_weights_balance(spark):
    df = spark.createDataFrame([(1,)] * 3 + [(0,)] * 1, "enhance_flag int")
    assert rows(model.class_weights(df)) == [(0, 1, 2.0), (1, 3, pytest.approx(2 / 3))]


def installs(spark, n=400):
    rng = np.random.default_rng(1)
    data = []
    for i in range(n):
        slow = float(rng.uniform(0, 100))
        after = 70 + (10 if slow > 50 else -10) + float(rng.normal(0, 2))
        cat = None if i % 10 == 0 else float(rng.uniform(-80, -40))
        data.append((f"h{i}", "x" if i % 50 else "zz", slow, slow / 2, 300.0, cat, cat, 70.0, after, 50, 10.0))
    return spark.createDataFrame(
        data,
        "serial_num string, dg_model_indiv string, poor_phyrate double, poor_rssi double, avg_phyrate double,"
        " avg_sig_strength_cat1 double, avg_sig_strength_cat2 double, before_home_score double,"
        " after_home_score double, count int, volume double",
    )


def test_recommendation_learns_and_repeats(spark):
    data = installs(spark).cache()
    rules = RecommendationRules(forest=ForestParams(trees=10))
    metrics, scored = model.recommend(data, data, ModelFamilies(("x",)), rules)
    assert min(r["accuracy"] for r in metrics.collect()) > 0.9
    _, again = model.recommend(data, data, ModelFamilies(("x",)), rules)
    assert rows(scored, "serial_num", "extender_score") == rows(again, "serial_num", "extender_score")
    assert scored.count() == 400


def test_logistic_and_population_share(spark):
    data = model.enhance_label(
        installs(spark).withColumn("score_increment", F.col("after_home_score") - F.col("before_home_score"))
    ).cache()
    fitted = model.fit_logistic(data)
    accuracy = model.classification_metrics(fitted.transform(data)).first()["accuracy"]
    assert accuracy > 0.9
    share = model.population_share(data, data, (0, 5), params=ForestParams(trees=5)).collect()
    assert [(r["threshold"], r["ones"] + r["zeros"]) for r in share] == [(0, 400), (5, 400)]


def test_population_rows_fill_and_drop(spark):
    df = installs(spark, 20).withColumn("volume", F.when(F.col("serial_num") == "h1", None).otherwise(F.col("volume")))
    out = {r["serial_num"]: r for r in model.population_rows(df).collect()}
    assert "h1" not in out and out["h0"]["avg_sig_strength_cat1"] == -60 and out["h0"]["avg_sig_strength_cat2"] == -65


@pytest.mark.parametrize("name", ["volume", "poor_rssi", "count", "before_home_score", "avg_sig_strength_cat1"])
def test_a_missing_feature_neither_ends_training_nor_scoring(spark, name):
    data = installs(spark, 150)
    gap = data.withColumn(name, F.when(F.col("serial_num") == "h7", None).otherwise(F.col(name)))
    metrics, scored = model.recommend(gap, gap)
    assert metrics.count() == 2
    got = {r.serial_num: r.extender_score for r in scored.collect()}
    assert all(v is not None for k, v in got.items() if k != "h7")
    if name in ("poor_rssi", "count"):
        assert got["h7"] is None
