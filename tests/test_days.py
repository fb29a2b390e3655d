from datetime import date

import pytest

from homescore.sources import days as D
from homescore.sources import files, sinks, staging
from tests.conftest import plan, rows


@pytest.fixture(scope="module")
def daily(spark):
    data = [(d, n) for d in (1, 2, 2, 4, 9) for n in (d,)]
    return spark.createDataFrame([(date(2024, 1, d), n) for d, n in data], "date date, n int")


def test_missing_days_are_skipped_or_raise(daily):
    assert rows(D.window_of_days(daily, "2024-01-01", 4), "n") == [(1,), (2,), (2,), (4,)]
    with pytest.raises(FileNotFoundError, match="2024-01-03"):
        D.window_of_days(daily, "2024-01-01", 4, on_missing="error")
    once = D.window_of_days(daily, "2024-01-01", 2, on_missing="error", dedup=True)
    assert rows(once, "n") == [(1,), (2,)]


def test_latest_snapshot_and_fallback(daily):
    assert rows(D.latest_snapshot(daily, "2024-01-08", 5, 1), "n") == [(4,)]
    assert rows(D.latest_snapshot(daily, "2024-01-09", 5, 0), "n") == [(9,)]
    assert D.latest_day(daily, "2024-01-08", 5, 1) == date(2024, 1, 4)
    with pytest.raises(FileNotFoundError):
        D.latest_day(daily, "2024-01-08", 2, 1)
    assert rows(D.snapshot_or_fallback(daily, "2024-01-05", "2024-01-01"), "n") == [(1,)]
    assert rows(D.snapshot_or_fallback(daily, "2024-01-04", "2024-01-01"), "n") == [(4,)]


def test_days_to_backfill(daily):
    assert D.days_to_backfill(daily, "2024-01-05", 4) == [date(2024, 1, 3)]


def test_day_table_prunes_and_overwrites_single_days(spark, daily, tmp_path):
    path = str(tmp_path / "t")
    sinks.overwrite_days(daily, path)
    sinks.overwrite_days(daily.where("date = date'2024-01-02'").selectExpr("date", "n + 100 as n"), path, files=1)
    stored = spark.read.parquet(path)
    assert rows(stored, "n") == [(1,), (102,), (102,), (4,), (9,)]
    assert "PartitionFilters: [isnotnull(date" in plan(D.window_of_days(stored, "2024-01-01", 2))
    assert rows(D.latest_snapshot(stored, "2024-01-08", 5, 1), "n") == [(4,)]
    folders = files.read_day_folders(spark, path + "/date={}", "2024-01-01", 4)
    assert rows(folders, "date", "n") == sorted(
        [(date(2024, 1, 1), 1), (date(2024, 1, 2), 102), (date(2024, 1, 2), 102), (date(2024, 1, 4), 4)], key=repr
    )
    with pytest.raises(FileNotFoundError):
        files.read_day_folders(spark, path + "/date={}", "2024-01-01", 4, on_missing="error")


def test_window_dataset_is_named_by_columns(spark, daily, tmp_path):
    path = str(tmp_path / "w")
    sinks.overwrite_window(daily.select("n"), path, "2024-02-21", 7)
    names = ("before_date", "install_date", "after_date", "window_days")
    assert rows(spark.read.parquet(path).select(*names).distinct()) == [
        (date(2024, 2, 14), date(2024, 2, 21), date(2024, 2, 28), 7)
    ]


def test_report_is_one_file(spark, daily, tmp_path):
    sinks.write_report_csv(daily.repartition(3), str(tmp_path / "r"))
    assert len(list((tmp_path / "r").glob("part-*.csv"))) == 1
    assert files.read_csv(spark, str(tmp_path / "r")).count() == 5


def test_jdbc_options_split_only_with_a_column():
    plain = files.jdbc_options("jdbc:x", "select 1", driver="d")
    assert plain["query"] == "select 1" and plain["queryTimeout"] == "3600"
    split = files.jdbc_options("jdbc:x", "select 1 as k", partition=("k", "0", "9", 3))
    assert "query" not in split and split["numPartitions"] == "3" and split["dbtable"].startswith("(select")


def test_staged_table_cuts_lineage(spark, daily):
    staged = staging.stage(daily, "t")
    assert rows(staged) == rows(daily)
    assert "FileScan parquet" in plan(staged)


def test_union_by_name(spark, daily):
    other = daily.select("n", "date")
    assert files.union_all([daily, other]).count() == 10


def test_days_are_told_apart_by_the_whole_path(spark, tmp_path):
    for day, n in (("2024-01-01", 1), ("2024-01-02", 2), ("2024-01-02 old", 9)):
        spark.range(n).write.parquet(str(tmp_path / "a b+c" / day / "map.parquet"))
    read = files.read_day_folders(spark, str(tmp_path / "a b+c") + "/{}/map.parquet", "2024-01-01", 3)
    assert rows(read.groupBy("date").count()) == [(date(2024, 1, 1), 1), (date(2024, 1, 2), 2)]


def test_a_day_without_rows_ends_up_empty(spark, daily, tmp_path):
    path = str(tmp_path / "e")
    sinks.overwrite_days(daily, path)
    sinks.overwrite_days(daily.where("false"), path, days=["2024-01-02"])
    assert rows(spark.read.parquet(path), "n") == [(1,), (4,), (9,)]
    assert D.table_or_none(spark, str(tmp_path / "none")) is None
