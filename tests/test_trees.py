"""Fitted models checked from outside: trees as tables, the logistic optimum, models kept on disk."""

import math

import pytest
from pyspark.sql import functions as F

from homescore.config import ForestParams, RecommendationRules
from homescore.operators import model, trees
from tests.conftest import plan, rows
from tests.test_model import installs


def walk(nodes, row):
    """Probability of class 1, tree by tree in plain Python."""
    by = {(n["tree"], n["node"]): n for n in nodes}
    shares = []
    for tree in sorted({n["tree"] for n in nodes}):
        n = by[tree, 0]
        while n["feature"] is not None:
            n = by[tree, n["left"] if row[n["feature"]] <= n["threshold"] else n["right"]]
        shares.append(n["weight_1"] / (n["weight_0"] + n["weight_1"]))
    return sum(shares) / len(shares)


@pytest.fixture(scope="module")
def fitted(spark):
    how = RecommendationRules()
    train = model.training_rows(installs(spark, 150)).cache()
    return model.fit_forest(train, how.features, how.imputed, ForestParams(trees=12, depth=4)), train


def test_table_gives_the_same_scores(spark, fitted):
    forest, train = fitted
    nodes = trees.tree_table(forest)
    assert nodes.select("tree").distinct().count() == 12
    assert nodes.where("(feature is null) <> (left is null)").count() == 0
    holes = train.withColumns({"avg_sig_strength_cat1": F.when(F.col("count") % 3 > 0, F.col("avg_sig_strength_cat1"))})
    holes = holes.withColumn("volume", F.when(F.crc32(F.col("serial_num").cast("binary")) % 5 > 0, F.col("volume")))
    a = {r["serial_num"]: r["extender_score"] for r in model.score_population(forest, holes).collect()}
    b = {r["serial_num"]: r["extender_score"] for r in trees.score_with_trees(forest, holes).collect()}
    assert a == b and None in a.values() and len(set(a.values())) > 5
    full = trees.filled(forest, train).select("serial_num", *RecommendationRules().features)
    chance = {r["serial_num"]: r["p"] for r in full.select("serial_num", trees.forest_probability(nodes).alias("p")).collect()}
    listed = nodes.collect()
    for r in full.collect():
        assert math.isclose(chance[r["serial_num"]], walk(listed, r), abs_tol=1e-12)


def test_rows_stay_where_they_are(spark, fitted):
    """Following the trees is one expression: no shuffle, no join, no Python."""
    forest, train = fitted
    table = spark.createDataFrame(trees.tree_table(forest).collect(), trees.tree_table(forest).schema)
    physical = plan(train.select(trees.forest_probability(table))).split("== Physical Plan ==")[-1]
    assert "Exchange" not in physical and "Join" not in physical and "Python" not in physical


def test_odd_tables(spark):
    schema = "tree int, node int, feature string, threshold double, left int, right int, weight_0 double, weight_1 double"
    leaf = spark.createDataFrame([(0, 0, None, None, None, None, 1.0, 3.0), (4, 0, None, None, None, None, 1.0, 1.0)], schema)
    df = spark.createDataFrame([(1.0,), (None,)], "x double")
    assert rows(df.select(trees.forest_probability(leaf))) == [(0.625,), (0.625,)]
    split = [(0, 0, "x", 1.0, 5, 9, 0.0, 0.0), (0, 5, None, None, None, None, 1.0, 0.0), (0, 9, None, None, None, None, 0.0, 2.0)]
    more = spark.createDataFrame([(1.0,), (1.0000001,), (None,), (math.nan,)], "x double")
    found = [r[0] for r in more.select(trees.forest_probability(spark.createDataFrame(split, schema))).collect()]
    assert found == [0.0, 1.0, None, None]
    with pytest.raises(ValueError):
        trees.forest_probability(spark.createDataFrame([], schema))


def test_kept_model_scores_alike(spark, fitted, tmp_path):
    forest, train = fitted
    model.keep_model(forest, str(tmp_path / "m"))
    again = model.kept_model(str(tmp_path / "m"))
    assert rows(model.score_population(again, train)) == rows(model.score_population(forest, train))


def test_recommendation_keeps_its_model(spark, tmp_path):
    path = str(tmp_path / "m")
    _, scored = model.recommend(installs(spark, 120), installs(spark, 40), keep=path)
    again = model.score_population(model.kept_model(path), model.population_rows(installs(spark, 40)), RecommendationRules().features)
    assert rows(again) == rows(scored)


def test_gradient_tells_an_optimum(spark):
    train = model.enhance_label(model.with_increment(installs(spark, 100)))
    best = model.fit_logistic(train)
    steep = model.logistic_gradient(best, train).selectExpr("max(abs(gradient) / scale) s").first()["s"]
    assert steep < 1e-6
    other = model.logistic(100).setMaxIter(1)
    rough = model.Pipeline(stages=[model.assembler(model.SWEEP_FEATURES), other]).fit(model.with_class_weight(train))
    assert model.logistic_gradient(rough, train).selectExpr("max(abs(gradient) / scale) s").first()["s"] > 1e-3
