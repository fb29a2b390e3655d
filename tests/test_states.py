"""Exact medians, daily states and presence bitmaps."""

import math
import random
import statistics
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from homescore.operators import cohort, features, medians, presence, states
from tests.conftest import plan, rows

START = date(2024, 1, 1)


def median_rows(spark, groups, at_once):
    data = [(k, float(v)) for k, values in groups.items() for v in values]
    df = spark.createDataFrame(data, "k string, v double")
    found = medians.medians(medians.value_counts(df, ["k"], ["v"]), ["k"], at_once)
    return {r["k"]: r["median"] for r in found.collect()}


def test_medians_of_any_size(spark):
    rng = random.Random(2)
    groups = {
        "odd": [3, 1, 2], "even": [4, 1, 3, 2], "one": [7], "same": [5.5] * 200, "zero": [0.0] * 30 + [-1, 1],
        "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(400)],
        "tiny": [5e-324 * k for k in range(300)], "near": [1 + k * 2**-52 for k in range(300)],
        "minus": [-rng.random() for _ in range(301)], "outlier": [rng.random() for _ in range(250)] + [1e308, -1e308],
        "endless": [math.inf] * 3 + [-math.inf] * 3 + [float(k) for k in range(100)],
    }
    want = {k: statistics.median_low(v) for k, v in groups.items()}
    for at_once in (5, 40, 1000):
        assert median_rows(spark, groups, at_once) == want


def test_hot_home_is_exact_and_never_ordered_whole(spark):
    """100,000 different values in one home: exact where a sketch is not, and only a range of them is ordered."""
    hot = spark.range(100_000).select(F.lit("hot").alias("k"), (F.pow(F.col("id") * 7919 % 100_003 + 1, 1.5) / 3).alias("v"))
    data = hot.union(spark.range(9).select(F.lit("few"), F.col("id").cast("double")))
    counts = medians.value_counts(data, ["k"], ["v"])
    got = {r["k"]: r["median"] for r in medians.medians(counts, ["k"], 2000).collect()}
    values = sorted(r["v"] for r in hot.select("v").collect())
    assert got == {"hot": values[49_999], "few": 4.0}
    groups = medians.value_counts(data, ["k"], ["v"]).groupBy("k", "name").agg(F.expr("(sum(n) + 1) div 2").alias("rank"), F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("values"))
    large = counts.join(groups.where("values > 2000"), ["k", "name"])
    narrowed = medians._middle_range(medians._middle_range(large, ["k", "name"], True).join(counts, ["k", "name"]).where("value between low and high"), ["k", "name"], False).collect()
    assert len(narrowed) == 1 and narrowed[0]["values"] < 2000


def test_no_value_no_median(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0)], "k string, v double")
    found = medians.medians(medians.value_counts(df, ["k"], ["v"]), ["k"])
    assert rows(medians.with_medians(df.select("k").distinct(), found, ["k"], ["v"])) == [("a", None), ("b", 1.0)]
    assert medians.medians(medians.value_counts(df.limit(0), ["k"], ["v"]), ["k"]).count() == 0


def devices(spark, n=400):
    rng = random.Random(6)
    data = [
        (f"h{rng.randrange(12)}", START + timedelta(rng.randrange(10)), rng.choice([None, rng.randrange(6400) / 64]), rng.randrange(64) / 32, rng.choice([None, -40.0, -50.5]))
        for _ in range(n)
    ]
    return spark.createDataFrame(data, "serial_num string, date date, device_score double, volume double, poor_rssi double")


@pytest.mark.parametrize("first, count", [(0, 7), (3, 2), (0, 10)])
def test_windows_from_states(spark, first, count):
    names = ("device_score", "volume", "poor_rssi")
    raw = devices(spark)
    inside = F.col("date").between(F.lit(START + timedelta(first)), F.lit(START + timedelta(first + count - 1)))
    merged = states.device_window(states.device_states(raw, names).where(inside), states.value_states(raw, names).where(inside), names, (), 5, True)
    plain = features.device_window(raw.where(inside), names, (), 5, True)
    assert rows(merged, *plain.columns) == rows(plain)


def test_states_are_small(spark):
    """A home and day is one row, with at most the lowest few scores."""
    found = states.device_states(devices(spark, 2000), ("device_score", "volume"), lowest_n=3)
    assert found.count() == found.select("serial_num", "date").distinct().count()
    assert found.agg(F.max(F.size("lowest"))).first()[0] == 3


def test_home_windows_from_states(spark):
    homes = devices(spark).selectExpr("serial_num", "date", "device_score home_score", "cast(volume * 32 as bigint) num_station", "if(volume > 1, 'r', 'e') dg_model_indiv")
    made = states.home_states(homes)
    for models, per_model, stations in ((["r"], True, True), (None, False, False), (["r", "e"], False, True)):
        plain = features.home_window(homes, models, per_model, stations)
        assert rows(states.home_window(made, models, per_model, stations)) == rows(plain)


def homes(spark):
    rng = random.Random(8)
    data = []
    for k in range(60):
        change = rng.randrange(12, 30)
        for d in range(80):
            if rng.random() > 0.004:
                data += [(f"h{k}", START + timedelta(d), m) for m in range(1 + (d >= change))]
    return spark.createDataFrame(data, "serial_num string, date date, dg_model_indiv int")


def test_cohorts_of_many_days(spark):
    """The same homes as one query a day, with bitmaps of more than one word."""
    rows_ = homes(spark)
    bitmaps = presence.row_count_bitmaps(rows_, START, 80)
    starts = [START + timedelta(d) for d in (10, 15, 16, 20, 25, 60, 70)]
    got = rows(presence.cohorts_by_counts(bitmaps, starts), "start", "serial_num")
    want = sorted(((d, r[0]) for d in starts for r in cohort.cohort_by_counts(rows_, d).collect()), key=repr)
    assert got == want and len({d for d, _ in want}) > 2
    with pytest.raises(ValueError):
        bitmaps.on_all("before", START - timedelta(1), 3)


def test_flag_cohorts_of_many_days(spark):
    rng = random.Random(9)
    data = []
    for k in range(80):
        on = rng.randrange(5, 90)
        for d in range(100):
            if rng.random() > 0.3:
                data.append((f"h{k}", START + timedelta(d), rng.choice([[int(d >= on)], [0, int(d >= on)], None, []])))
    df = spark.createDataFrame(data, "serial_num string, date date, Rou_Ext array<int>")
    bitmaps = presence.flag_bitmaps(df, START, 100)
    installs = [START + timedelta(d) for d in range(5, 90, 6)]
    want = sorted(((d, r[0]) for d in installs for r in cohort.rolling_cohort(df, d, 4).collect()), key=repr)
    assert rows(presence.cohorts_by_flags(bitmaps, installs, 4), "start", "serial_num") == want and want


def test_one_scan_for_all_start_days(spark, tmp_path):
    homes(spark).write.partitionBy("date").parquet(str(tmp_path / "h"))
    table = spark.read.parquet(str(tmp_path / "h"))
    found = presence.cohorts_by_counts(presence.row_count_bitmaps(table, START, 80), [START + timedelta(d) for d in range(10, 20)])
    physical = plan(found).split("== Physical Plan ==")[-1]
    assert physical.count("FileScan") == 1
    assert presence.cohorts_by_counts(presence.row_count_bitmaps(table, START, 80), []).count() == 0
