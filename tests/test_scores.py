import math

import pytest
from pyspark.sql import functions as F

from homescore.config import HOME_KEYS
from homescore.operators import score, topology
from homescore.operators import weights as W
from homescore.operators.kpi import device_kpis
from homescore.plans.queries import QUERIES
from tests.conftest import rows
from tests.test_kpi import frame, reading


def groups(spark, members):
    return spark.createDataFrame(
        members, "dg_rowkey string, RouExt_mac string, dg_model string, parent_mac string, firmware string"
    )


def identity(spark, members):
    return spark.createDataFrame(members, "serial_num string, mdn string, cust_id string")


@pytest.fixture(scope="module")
def homes(spark):
    """Three homes, six devices: h1 router + extender, h2 two subscribers, h3 no known model."""

    def device(home, mac, parent, rate, weak, sent):
        # Signals vary by 1 dB, so every device is stationary and survives the outlier rule.
        return [
            reading(home, mac, -80 + i % 2 if i < weak else -60 - i % 2, rate, "5G", parent, sent, 0)
            for i in range(40)
        ]

    data = device("h1", "a", "R1", 100, 10, 25) + device("h1", "b", "E1", 10, 0, 25)
    data += device("h2", "c", "R2", 64, 20, 100) + device("h2", "d", "R2", 200, 0, 1)
    data += device("h3", "e", "R3", 100, 0, 5) + device("h3", "f", "R3", 100, 4, 5)
    telemetry = frame(spark, data)
    dg = groups(
        spark,
        [("AAAA-h1", "R1", "router", None, "1"), ("AAAA-h1", "E1", "extender", "R1", "2"), ("AAAA-h2", "R2", "router", None, "1")],
    )
    ids = identity(spark, [("h1", "m1", "c1"), ("h2", "m2", "c2"), ("h2", "m3", "c3")])
    return telemetry, dg, ids


def scores_b(telemetry, dg, ids):
    return score.device_scores_b(device_kpis(telemetry), dg, ids)


def scores_c(telemetry, dg, ids):
    return score.device_scores_c(score.located_devices_c(device_kpis(telemetry), dg, ids))


def test_variant_b_by_hand(spark, homes):
    devices = {(r["station_mac"], r["mdn"]): r for r in scores_b(*homes).collect()}
    assert len(devices) == 8
    a, b = devices["a", "m1"], devices["b", "m1"]
    # p50 = -60 or -61 and p90 = -60: both are stationary; b runs at 10 of 20.718.
    label = 10 / 20.718
    first_a, first_b = round(1 / (1 + label), 4), round(label / (1 + label), 4)
    assert a["weights"] == round(first_a / (first_a + first_b), 4)
    assert b["weights"] == round(first_b / (first_a + first_b), 4)
    assert a["device_score"] == pytest.approx((100 - 25) * 0.4 + 100 * 0.6)
    assert b["device_score"] == pytest.approx(100 * 0.4 + 0 * 0.6)
    assert (a["Rou_Ext"], b["Rou_Ext"]) == ([0], [1])
    assert devices["c", "m2"]["weights"] == devices["c", "m3"]["weights"] == 0.5
    assert devices["e", None]["dg_model"] == []


def test_variant_c_by_hand(spark, homes):
    scored = scores_c(*homes)
    devices = {(r["station_mac"], r["mdn"]): r for r in scored.collect()}
    volume = math.log(25 * 40)
    cut = volume * 10 / 20.718
    assert devices["a", "m1"]["weights"] == pytest.approx(volume / (volume + cut))
    assert devices["a", "m1"]["device_score"] == pytest.approx(75 * 0.5 + 100 * 0.5)
    c, d = math.log(4000), math.log(40)
    assert devices["c", "m3"]["weights"] == pytest.approx(c / (c + d))
    sums = scored.groupBy(*HOME_KEYS).agg(F.sum("weights").alias("w")).collect()
    assert all(r["w"] == pytest.approx(1) for r in sums)


def test_cancelled_first_share_changes_nothing(spark, homes):
    """Variant C takes one share; the written-out rule takes two."""
    telemetry, dg, ids = homes
    twice = W.renormalise(topology.attach_identity(W.weights_c(device_kpis(telemetry)), ids))
    once = scores_c(*homes)
    first = {(r["station_mac"], r["mdn"]): r["weights"] for r in twice.collect()}
    second = {(r["station_mac"], r["mdn"]): r["weights"] for r in once.collect()}
    assert first.keys() == second.keys()
    assert all(second[k] == pytest.approx(first[k]) for k in first)


def test_homes_have_a_row_per_model_and_none_without(spark, homes):
    out = score.home_scores(scores_c(*homes))
    assert rows(out, "serial_num", "mdn", "dg_model_indiv", "num_station") == [
        ("h1", "m1", "extender", 2),
        ("h1", "m1", "router", 2),
        ("h2", "m2", "router", 2),
        ("h2", "m3", "router", 2),
    ]


def test_variant_a_shares_the_whole_table(spark, homes):
    telemetry, dg, ids = homes
    devices = score.device_scores_a(score.kpis_a(telemetry), dg, ids)
    got = {(r["station_mac"], r["mdn"]): r for r in devices.collect()}
    # Unknown homes count in the total but have no row.
    total = 5 + 10 / 20.718
    assert got["a", "m1"]["weights"] == round(100 / total, 4)
    assert {k[0] for k in got} == {"a", "b", "c", "d"}
    extenders = score.extender_rows(score.home_scores_a(devices)).collect()
    assert [(r["serial_num"], r["Rou_Ext"], r["firmware"]) for r in extenders] == [("h1", 1, "2")]


def test_zero_volume_and_zero_totals_give_null_weights(spark):
    data = [reading("h", m, -60 - i % 2, sent=0, received=0) for m in ("x", "y") for i in range(40)]
    shared = W.weights_c(device_kpis(frame(spark, data)))
    assert [r["weights"] for r in shared.collect()] == [None, None]
    zero = spark.createDataFrame([("h", 0.0), ("h", 0.0)], "k string, v double")
    assert rows(W.share_of_group(zero, ["k"], "v", "s"), "s") == [(None,), (None,)]


def test_shares_with_null_keys_and_a_hot_group(spark):
    data = [("hot" if i % 3 == 0 else f"g{i % 11}" if i % 3 == 1 else None, 1.0) for i in range(3000)]
    shared = W.share_of_group(spark.createDataFrame(data, "k string, v double"), ["k"], "v", "s")
    sums = shared.groupBy("k").agg(F.sum("s").alias("s"), F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in sums) == 3000
    assert all(r["s"] == pytest.approx(1) for r in sums)
    everything = W.share_of_all(spark.createDataFrame(data, "k string, v double"), "v", "s")
    assert everything.agg(F.sum("s")).first()[0] == pytest.approx(100)


def test_rescore_folds_repeated_rows(spark):
    stored = spark.createDataFrame(
        [
            ("h", "m", "c", "s1", 10.0, 0.0, 1.0, 95.0, ["a"], [0]),
            ("h", "m", "c", "s1", 10.0, 0.0, 1.0, 95.0, ["b"], [1]),
        ],
        "serial_num string, mdn string, cust_id string, station_mac string, poor_rssi double, poor_phyrate double,"
        " weights double, device_score double, dg_model array<string>, Rou_Ext array<int>",
    )
    assert rows(score.rescore_homes(stored), "home_score", "dg_model_indiv") == [(95.0, "a"), (95.0, "b")]


@pytest.mark.parametrize("name", ["home_score_a", "home_score_b", "home_score_c"])
def test_home_scores_do_not_depend_on_partitions(spark, name):
    found = set()
    try:
        for parts in ("2", "4", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            found.add(repr(rows(QUERIES[name](spark, "/root/testdata/sf0.001"))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(found) == 1


def test_ties_round_up(spark):
    """Halves of the fourth place, which sums of doubles would round by the order of rows."""
    data = [("h", "m", "c", str(k), 0.1, 0.1, w, 0.1, ["a"], [0]) for k, w in enumerate([0.3334, 0.3333, 0.3333] + [0.0005])]
    df = spark.createDataFrame(
        data,
        "serial_num string, mdn string, cust_id string, station_mac string, poor_rssi double, poor_phyrate double,"
        " weights double, device_score double, dg_model array<string>, Rou_Ext array<int>",
    )
    assert rows(score.home_scores(df), "home_score") == [(0.1001,)]


def test_scoring_operators_run_no_job(spark, homes):
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    scores_b(*homes), score.home_scores(scores_c(*homes)), score.device_scores_a(score.kpis_a(homes[0]), *homes[1:])
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before
