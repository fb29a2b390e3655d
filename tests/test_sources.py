"""Snapshots of many days, bad input and bucketed tables."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from homescore.operators import dataset, topology
from homescore.plans import queries
from homescore.sources import bucketed, days, files
from tests.conftest import plan, rows

START = date(2024, 5, 1)
SF = "/root/testdata/sf0.001"


def day(k):
    return START + timedelta(k)


@pytest.fixture()
def snapshots(spark, tmp_path):
    data = [(k, v) for k in (0, 1, 5, 9) for v in range(3)]
    df = spark.createDataFrame([(day(k), k * 10 + v) for k, v in data], "date date, v int")
    df.write.partitionBy("date").parquet(str(tmp_path / "t"))
    return spark.read.parquet(str(tmp_path / "t"))


def test_as_of_is_the_newest_in_reach(spark, snapshots):
    targets = [day(k) for k in range(-1, 14)]
    for back, least in ((3, 0), (3, 1), (2, 2), (30, 0)):
        got = {(r["as_of"], r["date"]) for r in days.as_of(snapshots, targets, back, least).select("as_of", "date").collect()}
        want = set()
        for t in targets:
            fitting = [day(k) for k in (0, 1, 5, 9) if back >= (t - day(k)).days >= least]
            want |= {(t, max(fitting))} if fitting else set()
        assert got == want
        for t, s in want:
            one = days.latest_snapshot(snapshots, t, back, least)
            assert rows(days.as_of(snapshots, [t], back, least), "date", "v") == rows(one, "date", "v")


def test_as_of_scans_each_table_once(spark, snapshots):
    found = days.as_of(snapshots, [day(k) for k in range(5, 9)], 4)
    physical = plan(found).split("== Physical Plan ==")[-1]
    assert physical.count("FileScan") == 1 and "PartitionFilters: [isnotnull" in physical or "PartitionFilters: [date" in physical
    assert found.select(F.input_file_name()).distinct().count() <= 6  # of the two snapshots that serve a day
    assert days.as_of(snapshots, [day(40)], 3).count() == 0 and days.as_of(snapshots, [], 3).columns == ["v", "date", "as_of"]


def test_identity_of_its_own_day(spark):
    mapping = spark.createDataFrame(
        [("m1", "s", "c", "INSTALL COMPLETE", day(0), day(1)), ("m2", "s", "c", "INSTALL COMPLETE", day(2), day(3)), ("m3", "s", "c", "PENDING", day(2), day(3))],
        "mdn_5g string, serialnumber string, cust_id string, status string, date date, as_of date",
    )
    df = spark.createDataFrame([("s", day(1)), ("s", day(3)), ("s", day(4)), ("x", day(3))], "serial_num string, date date")
    assert rows(topology.attach_identity_as_of(df, mapping), "date", "serial_num", "mdn") == sorted(
        [(day(1), "s", "m1"), (day(3), "s", "m2"), (day(4), "s", None), (day(3), "x", None)], key=repr
    )
    assert topology.attach_identity_as_of(df, mapping, None, "inner").count() == 3


SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.DoubleType()), T.StructField("s", T.StringType())])


def write_lines(spark, path, lines):
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)


def test_bad_json(spark, tmp_path):
    lines = ['{"id": 1, "v": 2.5, "s": "ok"}', '{"id": 2, "v": ', "[]", "", '{"id": "x", "v": 1}', '{"v": 1, "s": "no id"}', '{"id": 5, "v": 1e9}', '{"id": 6, "more": 1}', "plain"]
    write_lines(spark, str(tmp_path / "in"), lines)
    marked = files.read_marked(spark, str(tmp_path / "in"), SCHEMA, required=("id",), checks={"too large": F.col("v") > 100})
    assert rows(marked.where("reason is null"), "id", "v", "s") == [(1, 2.5, "ok"), (6, None, None)]
    bad = {(r["reason"], r["line"]) for r in marked.where("reason is not null").collect()}
    assert {('malformed', '{"id": 2, "v": '), ("malformed", '{"id": "x", "v": 1}'), ("malformed", "plain"), ("no id", None), ("too large", None)} <= bad
    good = files.set_aside(marked, str(tmp_path / "aside"))
    assert good.columns == ["id", "v", "s"] and good.count() == 2
    aside = spark.read.parquet(str(tmp_path / "aside"))
    assert good.count() + aside.count() == marked.count()
    assert dict(rows(files.reason_counts(marked)))["good"] == 2


@pytest.mark.parametrize("header", [True, False])
def test_bad_csv(spark, tmp_path, header):
    lines = ["1,2.5,ok", "2,much,bad", "3,1", "4,1,a,b", ",1,x", '5,1e9,"quoted, text"', "6,,"]
    spark.createDataFrame([("\n".join((["id,v,s"] if header else []) + lines),)], "value string").coalesce(1).write.text(str(tmp_path / "in"))
    marked = files.read_marked(spark, str(tmp_path / "in"), SCHEMA, "csv", ("id",), {"too large": F.col("v") > 100}, header=header)
    assert dict(rows(files.reason_counts(marked))) == {"good": 2, "malformed": 3, "no id": 1, "too large": 1}
    assert rows(marked.where("reason is null").select("id", "v", "s")) == [(1, 2.5, "ok"), (6, None, None)]


def test_buckets_spare_the_shuffle(spark, tmp_path):
    """Between the scans of bucketed tables and the join of a training set nothing is shuffled."""
    devices = spark.createDataFrame(
        [(f"h{k % 9}", day(k % 20), float(k), 1.0) for k in range(400)], "serial_num string, date date, device_score double, volume double"
    )
    homes = spark.createDataFrame([(f"h{k % 9}", day(k % 20), float(k % 7)) for k in range(180)], "serial_num string, date date, home_score double")
    stored = [bucketed.write_bucketed(df, f"bucketed_{n}", str(tmp_path / n), 4) for n, df in (("devices", devices), ("homes", homes))]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        make = lambda d, h: dataset.before_after_set(d, h, None, day(0), day(10), 5, ("device_score", "volume"))
        found = make(*stored)
        physical = plan(found).split("== Physical Plan ==")[-1]
        assert "Exchange" not in physical and "SortMergeJoin" in physical
        assert "Exchange" in plan(make(devices, homes)).split("== Physical Plan ==")[-1]
        assert rows(found) == rows(make(devices, homes))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for n in ("devices", "homes"):
            spark.sql(f"drop table bucketed_{n}")
    again = bucketed.open_bucketed(spark, "bucketed_again", str(tmp_path / "devices"), devices.schema, 4)
    summed = again.groupBy("serial_num").agg(F.sum("device_score").alias("s"))
    assert "Exchange" not in plan(summed).split("== Physical Plan ==")[-1]
    assert rows(summed) == rows(devices.groupBy("serial_num").agg(F.sum("device_score").alias("s")))
    spark.sql("drop table bucketed_again")


def test_days_within_buckets(spark, tmp_path):
    df = spark.createDataFrame([(f"h{k % 5}", day(k % 3), k) for k in range(60)], "serial_num string, date date, v int")
    stored = bucketed.write_bucketed(df, "bucketed_days", str(tmp_path / "d"), 3, partition_by=("date",))
    window = stored.where(F.col("date") <= F.lit(day(1)))
    assert "Exchange" not in plan(window.groupBy("serial_num").count()).split("== Physical Plan ==")[-1]
    spark.sql("drop table bucketed_days")
    columns = T.StructType([T.StructField("serial_num", T.StringType()), T.StructField("v", T.IntegerType()), T.StructField("date", T.DateType())])
    again = bucketed.open_bucketed(spark, "bucketed_days", str(tmp_path / "d"), columns, 3, partition_by=("date",))
    assert rows(again.select("serial_num", "date", "v")) == rows(df)
    spark.sql("drop table bucketed_days")


def test_variant_c_reads_telemetry_once(spark, monkeypatch):
    """Device figures are staged, so parents and figures do not each scan the readings."""
    seen = []
    stage = queries.staging.stage
    monkeypatch.setattr(queries.staging, "stage", lambda df, name: seen.append((name, plan(df).split("== Physical Plan ==")[-1])) or stage(df, name))
    made = queries._scores_c(spark, SF)
    telemetry = [p.count("lineitem") for name, p in seen if name == "device-kpis"]
    assert telemetry == [1] or [p.count("FileScan") for name, p in seen if name == "device-kpis"] == [1]
    located = next(p for name, p in seen if name == "located-devices")
    assert "l_quantity" not in located  # group records name other columns of the same table
    assert made.count() > 0
