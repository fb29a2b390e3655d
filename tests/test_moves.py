"""How often the topology and score steps move rows, and what moves with them."""

import pytest

from homescore import adapter
from homescore.operators import score, topology
from homescore.schemas import GROUP_ROOT
from tests.conftest import plan, rows
from tests.test_kpi import frame, reading


@pytest.fixture
def large(spark):
    """Plans as for tables too large to broadcast."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for key, value in zip(before, ("-1", "false")):
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.set(key, value)


def physical(df):
    return plan(df).split("== Physical Plan ==")[1]


def records(spark):
    member = "struct<mac string, model string, parent_mac string, fw string>"
    data = [
        ("AAAA-h1", [("R1", "router", None, "1"), ("E1", "extender", "R1", "2"), ("E1", "extender", "R0", "3")]),
        ("AAAA-h1", [("E1", "extender", None, "1"), (None, "spare", None, None)]),
        (None, [("R1", None, "x", "1"), ("R1", None, "y", "0")]),
        ("AAAA-h2", []),
    ]
    return spark.createDataFrame(data, f"rowkey string, {GROUP_ROOT} array<{member}>")


def scored(spark):
    telemetry = frame(spark, [reading("h1", m, -60 - i % 2, parent=p) for m, p in (("a", "R1"), ("b", "E1")) for i in range(40)])
    ids = spark.createDataFrame([("h1", "m1", "c1"), ("h1", "m2", "c2")], "serial_num string, mdn string, cust_id string")
    return telemetry, topology.device_groups(records(spark)), ids


def test_groups_are_moved_before_they_are_combined(large):
    text = physical(topology.device_groups(records(large)))
    assert text.count("Exchange") == 1
    assert "Aggregate" not in text.split("Exchange")[1]


def test_groups_of_repeated_and_null_members(spark):
    assert rows(topology.device_groups(records(spark))) == sorted(
        [
            ("AAAA-h1", "R1", "router", None, "1"),
            ("AAAA-h1", "E1", "extender", "R1", "3"),
            ("AAAA-h1", None, "spare", None, None),
            (None, "R1", None, "y", "1"),
        ],
        key=repr,
    )


def test_topology_moves_each_side_once(large):
    pairs = large.createDataFrame([("AAAA-h1", "E1"), ("AAAA-h1", "X"), (None, "R1")], "rk_row_sn string, parent_id string")
    joined = topology.attach_topology(pairs, topology.device_groups(records(large)))
    assert physical(joined).count("Exchange") == 2
    assert rows(joined, "parent_id", "dg_model", "Rou_Ext") == [("E1", "extender", 1), ("R1", None, 0), ("X", None, 0)]


def test_group_records_move_pairs_once(large, tmp_path):
    large.createDataFrame([(1, 2), (1, 2), (None, 3), (4, 3)], "l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    parts = [(2, "ECONOMY", "b2", 2), (3, "PROMO", "b3", 3)]
    large.createDataFrame(parts, "p_partkey long, p_type string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    found = adapter.group_records(large, str(tmp_path))
    assert physical(found).count("Exchange") == 2
    assert found.count() == 3


@pytest.mark.parametrize("variant", ["b", "c"])
def test_device_sets_stay_where_they_were_built(large, variant):
    telemetry, groups, ids = scored(large)
    if variant == "b":
        devices = score.device_scores_b(score.kpis_b(telemetry), groups, ids)
    else:
        devices = score.device_scores_c(score.located_devices_c(score.device_kpis(telemetry), groups, ids))
    stored = score.rounded_device_scores(devices)
    text = physical(stored)
    assert "Exchange" not in text[: text.index("SortMergeJoin [rowkey")]
    sets = {line.split("Aggregate(")[1][:60] for line in text.splitlines() if "partial_collect_set(RouExt_mac" in line}
    after = text[text.index("partial_collect_set(RouExt_mac") :].splitlines()[1:3]
    assert sets and any("Exchange" in line for line in after)
    assert stored.count() == 4


def test_variant_b_stages_what_it_needs(spark):
    assert not {"volume", "byte_send", "avg_sig_strength_cat1"} & set(score.kpis_b(scored(spark)[0]).columns)


def test_variant_a_finds_subscribers_of_extender_devices_only(large):
    telemetry, groups, ids = scored(large)
    devices = score.extender_rows(score.device_scores_a(score.kpis_a(telemetry), groups, ids))
    text = physical(devices)
    assert text.index("SortMergeJoin [serial_num") < text.index("SortMergeJoin [rk_row_sn")
    assert devices.columns[:5] == ["serial_num", "rowkey", "rk_row_sn", "station_mac", "parent_id"]
    assert rows(devices, "station_mac", "mdn", "dg_model", "firmware") == [("b", "m1", "extender", "3"), ("b", "m2", "extender", "3")]
