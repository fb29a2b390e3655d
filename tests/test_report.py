import numpy as np

from homescore.config import ImprovementRule, ModelFamilies
from homescore.operators import report
from tests.conftest import rows


def increments(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "score_increment double")


def test_bucket_edges(spark):
    out = report.increment_distribution(increments(spark, [-21, -20, -0.1, 0, 9.9, 10, 50, 70, 70.1]))
    assert rows(out) == [
        ("[-20, 0)", 2, 28.57),
        ("[0, 10)", 2, 28.57),
        ("[10, 20)", 1, 14.29),
        ("[50, 70]", 2, 28.57),
    ]


def test_histogram_matches_numpy(spark):
    values = list(np.random.default_rng(3).uniform(-30, 60, 500)) + [-20.0, 50.0]
    out = report.histogram(increments(spark, values), "score_increment", -20, 50, 20)
    expected, _ = np.histogram(values, bins=20, range=(-20, 50))
    assert [r["count"] for r in out.orderBy("bin").collect()] == list(expected)


def test_feature_bins_list_empty_bins(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.5, -1.0), (9.0, 3.0)], "f double, score_increment double")
    out = report.feature_bins(df, {"f": (0, 2, 4, 10)})
    assert rows(out, "bin", "score_increment_pos", "count") == [(0, 50.0, 2), (1, None, 0), (2, 100.0, 1)]


def test_rule_summary(spark):
    df = spark.createDataFrame(
        [(300.0, 10.0, 30.0, 300, 1.0), (300.0, 10.0, 30.0, 300, -1.0), (500.0, 10.0, 30.0, 300, 1.0)],
        "avg_phyrate double, poor_phyrate double, poor_rssi double, count int, score_increment double",
    )
    assert rows(report.rule_summary(df)) == [(3, 2, 66.67, 50.0)]
    none = report.rule_summary(df, ImprovementRule(count_above=1000))
    assert rows(none) == [(3, 0, 0.0, None)]


def test_model_family_drops_unknown(spark):
    df = spark.createDataFrame([("a",), ("b",), ("x",)], "dg_model_indiv string")
    assert rows(report.model_family(df, ModelFamilies(("a",), ("b",)))) == [("a",), ("others",)]


def test_listed_order(spark):
    df = spark.sql(
        """select 'h' as serial_num, date'2024-01-01' as date, 1.0D as home_score, array(array('a', 'b')) as dg_model"""
    )
    out = report.day_model(df, ["b", "a"], in_list_order=True)
    assert [r["dg_model"] for r in out.collect()] == ["b", "a"]
