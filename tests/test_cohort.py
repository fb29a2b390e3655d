from datetime import date, timedelta

from homescore.operators import cohort as C
from tests.conftest import plan, rows

START = date(2024, 3, 10)


def home_rows(home, before, after, skip=()):
    out = []
    for i in range(-7, 8):
        day = START + timedelta(i)
        if day not in skip:
            out += [(home, day, f"m{k}") for k in range(before if i < 0 else after)]
    return out


def test_counts_need_every_day(spark):
    data = home_rows("good", 1, 2) + home_rows("never", 1, 1) + home_rows("always", 2, 2)
    data += home_rows("gap_before", 1, 2, [START - timedelta(3)]) + home_rows("gap_after", 1, 2, [START])
    data += home_rows("three", 1, 3)
    homes = spark.createDataFrame(data, "serial_num string, date date, dg_model_indiv string")
    assert rows(C.cohort_by_counts(homes, START)) == [("good",)]
    assert "Join" not in plan(C.cohort_by_counts(homes, START))


def device_rows(home, flags):
    return [(home, START + timedelta(i), f) for i, f in flags]


def test_flags_in_three_phases(spark):
    data = device_rows("good", [(-1, [0]), (0, [0, 1]), (3, [1])])
    data += device_rows("had_one", [(-1, [1]), (0, [1]), (3, [1])])
    data += device_rows("gone", [(-1, [0]), (0, [1]), (3, [0])])
    data += device_rows("absent_before", [(0, [1]), (3, [1])])
    data += device_rows("empty_before", [(-1, []), (0, [1]), (3, [1])])
    devices = spark.createDataFrame(data, "serial_num string, date date, Rou_Ext array<int>")
    assert rows(C.rolling_cohort(devices, START, 3)) == [("good",)]
    assert rows(C.rolling_cohort(devices, START, 3, after_phase="install")) == [("gone",), ("good",)]
    assert rows(C.rolling_cohort(devices, START, 3, first_offset=1)) == []
    assert rows(C.flag_window(devices, START - timedelta(3), 3)) == [("gone", 0), ("good", 0), ("had_one", 1)]


def test_months_around_the_year_end(spark):
    data = [("h", date(2023, 12, 5), [0]), ("h", date(2024, 1, 5), [1]), ("h", date(2024, 2, 5), [1])]
    devices = spark.createDataFrame(data, "serial_num string, date date, Rou_Ext array<int>")
    assert rows(C.cohort_by_month(devices, 2024, 1)) == [("h",)]


def test_snapshot_keeps_homes_of_a_model(spark):
    telemetry = spark.createDataFrame([("h1", 1), ("h2", 2), ("h1", 3)], "serial_num string, n int")
    homes = spark.createDataFrame([("h1", "x"), ("h1", "x"), ("h2", "y")], "serial_num string, dg_model_indiv string")
    assert rows(C.model_snapshot(telemetry, homes, "x")) == [("h1", 1), ("h1", 3)]


def test_subscriber_list_or_table(spark):
    df = spark.createDataFrame([("a",), ("b",)], "mdn string")
    assert rows(C.subscribers(df, ["a"])) == rows(C.subscribers(df, df.where("mdn = 'a'"))) == [("a",)]
