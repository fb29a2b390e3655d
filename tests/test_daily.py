"""The daily job on small tables written to disk."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from homescore.config import ModelFamilies
from homescore.plans import daily
from homescore.schemas import DEVICE_GROUPS, STATION_HISTORY, SUBSCRIBER_MAP
from tests.conftest import rows
from tests.test_cohort import home_rows

DAY = date(2024, 3, 10)


def station(mac, parent, kind, rate, signal):
    text = ["1"] * 17
    text[:6] = [mac, parent, kind, rate, rate, signal]
    return tuple(text)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("tables")
    paths = daily.Tables(*[str(base / n) for n in daily.Tables.__dataclass_fields__])
    key = "ABCD-SERIAL00001-202403100000"
    for delivered in (DAY, DAY + timedelta(1)):
        readings = [
            (key, 1710000000000 + i, station(mac, parent, kind, "144.5Mbps", str(-60 - i % 4)))
            for mac, parent, kind in (("a", "R", "5GHz"), ("b", "E", "2.4GHz"), ("w", "R", "Ethernet"))
            for i in range(40)
        ]
        history = spark.createDataFrame(readings, STATION_HISTORY).withColumn("date", F.lit(delivered))
        history.write.mode("append").partitionBy("date").parquet(paths.station_history)
    members = [("ABCD-SERIAL00001", [("R", "router", None, "1"), ("E", "ext", "R", "1")])]
    groups = spark.createDataFrame(members, DEVICE_GROUPS).withColumn("date", F.lit(DAY - timedelta(2)))
    groups.write.partitionBy("date").parquet(paths.device_groups)
    mapping = spark.createDataFrame([("m1", "SERIAL00001", "c1", "INSTALL COMPLETE")], SUBSCRIBER_MAP)
    mapping.withColumn("date", F.lit(DAY - timedelta(1))).write.partitionBy("date").parquet(paths.subscriber_map)
    return paths


def test_backfill_then_population(spark, tables):
    assert daily.backfill_scores(spark, tables, DAY + timedelta(1), back=2).done == [DAY, DAY - timedelta(1)]
    assert daily.backfill_scores(spark, tables, DAY + timedelta(1), back=2) == daily.Outcome()
    homes = spark.read.parquet(tables.home_score)
    columns = ("date", "serial_num", "mdn", "dg_model_indiv", "num_station", "home_score")
    expected = [(d, "SERIAL00001", "m1", m, 2, 100.0) for d in (DAY, DAY - timedelta(1)) for m in ("ext", "router")]
    assert rows(homes, *columns) == sorted(expected, key=repr)
    daily.population_day(spark, tables, DAY, ["router"])
    population = spark.read.parquet(tables.router_population)
    assert rows(population, "serial_num", "before_home_score", "count") == [("SERIAL00001", 100.0, 2)]


def test_missing_snapshot_is_an_error(spark, tables):
    with pytest.raises(FileNotFoundError):
        daily.score_day(spark, tables, DAY + timedelta(5))


def test_install_list_needs_every_day(spark, tables, tmp_path):
    home_days = spark.createDataFrame(home_rows("h", 1, 2), "serial_num string, date date, dg_model_indiv string")
    homes = home_days.withColumns({"home_score": F.lit(80.0), "num_station": F.lit(3)})
    names = ("avg_phyrate poor_phyrate poor_rssi device_score weights stationarity volume"
             " avg_sig_strength_cat1 avg_sig_strength_cat2 avg_sig_strength_cat3").split()
    devices = home_days.select("serial_num", "date", *[F.lit(1.0).alias(n) for n in names])
    paths = daily.Tables(**{
        **tables.__dict__,
        "home_score": str(tmp_path / "h"),
        "device_score": str(tmp_path / "d"),
        "install_list": str(tmp_path / "i"),
    })
    homes.write.partitionBy("date").parquet(paths.home_score)
    devices.write.partitionBy("date").parquet(paths.device_score)
    daily.install_list_day(spark, paths, DAY, ["m0"])
    out = spark.read.parquet(paths.install_list)
    assert rows(out, "serial_num", "dg_model_indiv", "before_home_score", "after_home_score", "count") == [
        ("h", "m0", 80.0, 80.0, 7)
    ]
    with pytest.raises(FileNotFoundError):
        daily.install_list_day(spark, paths, DAY + timedelta(1), ["m0"])


def test_recommendation_is_written(spark, tables, tmp_path):
    from tests.test_model import installs

    data = installs(spark, 120).withColumn("date", F.lit(DAY))
    paths = daily.Tables(**{
        **tables.__dict__,
        "install_list": str(tmp_path / "i"),
        "router_population": str(tmp_path / "p"),
        "extender_score": str(tmp_path / "e"),
    })
    for path in (paths.install_list, paths.router_population):
        data.write.partitionBy("date").parquet(path)
    metrics = daily.recommend_day(spark, paths, DAY, ModelFamilies(("x",)))
    assert metrics.count() == 2
    scored = spark.read.parquet(paths.extender_score)
    assert scored.count() == 120 and scored.where("extender_score between 0 and 1").count() == 120


def test_a_failing_day_stops_neither_other_days_nor_the_recommendation(spark, tables, tmp_path):
    from tests.test_model import installs

    data = installs(spark, 120)
    paths = daily.Tables(**{
        **tables.__dict__,
        **{n: str(tmp_path / n) for n in ("home_score", "device_score", "install_list", "router_population", "extender_score")},
    })
    today = DAY + timedelta(1)
    data.withColumn("date", F.lit(today - timedelta(60))).write.partitionBy("date").parquet(paths.install_list)
    metrics, outcomes = daily.run_day(spark, paths, today, ModelFamilies(("router",)))
    assert outcomes["scores"].done == [DAY, DAY - timedelta(1)]
    assert len(outcomes["scores"].failed) == 7 and "snapshot" in outcomes["scores"].failed[DAY - timedelta(5)]
    assert outcomes["population"].done == [DAY] and not outcomes["installs"].done
    assert len(outcomes["installs"].failed) == 10
    assert outcomes["recommendation"].failed.keys() == {DAY} and metrics is None
    # nobody is of the family, so nothing can be learned; with the right family the same day works
    data.withColumn("date", F.lit(DAY)).write.mode("append").partitionBy("date").parquet(paths.router_population + "2")
    again = daily.Tables(**{**paths.__dict__, "router_population": paths.router_population + "2"})
    metrics = daily.recommend_day(spark, again, DAY, ModelFamilies(("x",)))
    assert metrics.count() == 2


def test_archive_counts_as_written(spark, tables, tmp_path):
    paths = daily.Tables(**{**tables.__dict__, "home_score": str(tmp_path / "h"), "device_score": str(tmp_path / "d")})
    archive = str(tmp_path / "old")
    spark.createDataFrame([(DAY, 1)], "date date, n int").write.partitionBy("date").parquet(archive)
    assert daily.backfill_scores(spark, paths, DAY + timedelta(1), back=2, archive=archive).done == [DAY - timedelta(1)]


def test_feature_and_training_jobs(spark, tables, tmp_path):
    daily.features_day(spark, tables.station_history, str(tmp_path / "f"), DAY)
    assert spark.read.parquet(str(tmp_path / "f")).where(F.col("date") == F.lit(DAY)).count() == 2
    names = ("avg_phyrate poor_phyrate poor_rssi weights stationarity volume"
             " avg_sig_strength_cat1 avg_sig_strength_cat2 avg_sig_strength_cat3").split()
    days = [(DAY + timedelta(k), [int(k >= 0)]) for k in range(-7, 14)]
    devices = spark.createDataFrame([("h", d, f) for d, f in days], "serial_num string, date date, Rou_Ext array<int>")
    devices = devices.select("*", F.lit(70.0).alias("device_score"), *[F.lit(1.0).alias(n) for n in names])
    homes = devices.select("serial_num", "date", F.lit(80.0).alias("home_score"))
    paths = daily.Tables(**{**tables.__dict__, "home_score": str(tmp_path / "h"), "device_score": str(tmp_path / "d")})
    homes.write.partitionBy("date").parquet(paths.home_score)
    devices.write.partitionBy("date").parquet(paths.device_score)
    daily.training_dataset(spark, paths, str(tmp_path / "t"), DAY)
    out = spark.read.parquet(str(tmp_path / "t"))
    assert rows(out, "serial_num", "install_date", "window_days", "count") == [("h", DAY, 7, 7)]
