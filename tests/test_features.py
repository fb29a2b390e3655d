import math
from datetime import date, timedelta

import pytest

from homescore.operators import dataset, features
from tests.conftest import plan, rows

FEATURES = ("device_score", "volume")


def test_lowest_n(spark):
    data = [("h", float(v)) for v in (9, 1, 5, 2, 4, 3)] + [("few", 2.0), ("few", 4.0), ("none", None)]
    df = spark.createDataFrame(data, "serial_num string, device_score double")
    lowest = features.lowest_n_mean(df, ["serial_num"])
    assert rows(lowest) == [("few", 3.0), ("h", 3.0)]
    # The rank limit runs before the shuffle, so no home is gathered whole.
    assert plan(lowest).count("WindowGroupLimit") >= 2
    window = features.device_window(df, ["device_score"])
    assert rows(window, "serial_num", "lowest_n_scores", "count") == [("few", 3.0, 2), ("h", 3.0, 6), ("none", None, 1)]


def test_window_figures(spark):
    df = spark.createDataFrame(
        [("h", 1.0, 0.0), ("h", 2.0, 1.0), ("h", 6.0, 2.0)], "serial_num string, device_score double, volume double"
    )
    row = features.device_window(df, FEATURES, total_volume=True).first()
    assert (row["device_score"], row["median_volume"], row["count"]) == (3.0, 1.0, 3)
    assert row["total_volume"] == pytest.approx(1 + math.e + math.e**2, abs=1e-4)
    assert "median_device_score" not in row
    assert "median_device_score" in features.device_window(df, FEATURES, median_exclude=()).columns


def days(spark):
    start = date(2024, 1, 1)
    devices = [("h", start + timedelta(i), 50.0 + i, 1.0) for i in range(9)]
    devices += [("early", start, 70.0, 1.0)]
    homes = [(h, d, s, "r", 2) for h, d, s, _ in devices]
    return (
        spark.createDataFrame(devices, "serial_num string, date date, device_score double, volume double"),
        spark.createDataFrame(
            homes, "serial_num string, date date, home_score double, dg_model_indiv string, num_station bigint"
        ),
    )


def test_before_after_needs_both_windows(spark):
    devices, homes = days(spark)
    out = dataset.before_after_set(devices, homes, None, "2024-01-01", "2024-01-07", 3, FEATURES)
    assert rows(
        out, "serial_num", "before_home_score", "after_home_score", "avg_device_score", "target_avg_device_score", "count"
    ) == [("h", 51.0, 57.0, 51.0, 57.0, 3)]
    without = dataset.before_after_set(devices, None, None, "2024-01-01", "2024-01-07", 3, FEATURES, None)
    assert "before_home_score" not in without.columns and without.count() == 1


def test_install_rows_leave_out_the_start_day(spark):
    devices, homes = days(spark)
    cohort = spark.createDataFrame([("h",)], "serial_num string")
    row = dataset.install_set(devices, homes, cohort, "2024-01-04", ["r"], 3, 4, FEATURES).first()
    assert (row["before_home_score"], row["after_home_score"]) == (51.0, 55.0)
    assert (row["num_station"], row["date_string"]) == (2.0, "2024-01-04")


def test_population_covers_the_days_before(spark):
    devices, homes = days(spark)
    out = dataset.router_population(devices, homes, "2024-01-04", 3, ["r"], FEATURES)
    assert rows(out, "serial_num", "before_home_score") == [("early", 70.0), ("h", 51.0)]
    assert dataset.router_population(devices, homes, "2024-01-04", 3, ["x"], FEATURES).count() == 0


def test_single_reading_has_no_deviation(spark):
    df = spark.createDataFrame([("AAAA-s-202401010000", "s", "m", 5)], "rowkey string, serial_num string, station_mac string, snr int")
    assert rows(features.device_features(df, ["snr"])) == [("AAAA-s-202401010000", "s", "m", 5.0, None)]


def test_overlapping_windows_count_in_both(spark):
    devices, homes = days(spark)
    out = dataset.before_after_set(devices, homes, None, "2024-01-01", "2024-01-03", 5, FEATURES)
    assert rows(out, "avg_device_score", "target_avg_device_score", "before_lowest_n_scores", "target_lowest_n_scores") == [
        (52.0, 54.0, 52.0, 54.0)
    ]
