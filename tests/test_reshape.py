from homescore.operators import reshape as R
from tests.conftest import plan, rows


def test_flatten_names_and_order(spark):
    df = spark.sql("select struct(1 as x, struct(2 as z) as y) as a, 3 as b, array(4) as c")
    flat = R.flatten_structs(df)
    assert flat.columns == ["b", "c", "a_b_x", "a_b_y_b_z"]
    assert rows(flat) == [(3, [4], 1, 2)]
    assert R.flatten_structs(flat).columns == flat.columns


def test_flatten_all_gives_every_combination_and_drops_empty(spark):
    df = spark.sql(
        """select * from values
           (1, array(1, 2), array(named_struct('k', 'a'), named_struct('k', 'b'))),
           (2, array(), array(named_struct('k', 'a'))),
           (3, null, array(named_struct('k', 'a'))) as t(id, xs, ys)"""
    )
    assert rows(R.flatten_all(df)) == [(1, 1, "a"), (1, 1, "b"), (1, 2, "a"), (1, 2, "b")]


def test_explode_levels(spark):
    df = spark.sql("select array(array(1, 2), cast(null as array<int>), array(3)) as v")
    assert rows(R.explode_column(df, "v", depth=2)) == [(1,), (2,), (3,)]


def test_casts_and_rounding(spark):
    df = spark.sql("select 'x' as name, '1.5' as a, 'bad' as b, 2 as c")
    assert rows(R.cast_all_but(df, ["name"])) == [("x", 1.5, None, 2.0)]
    named = R.rename_and_cast(df, {"a": ("long", "whole"), "name": ("string", "label")})
    assert rows(named, "whole", "label") == [(1, "x")]
    nums = spark.sql("select 2.675D as a, 1.005D as b, 7 as n")
    assert rows(R.round_columns(nums, 2)) == [(2.68, 1.01, 7)]
    assert rows(R.round_columns(nums, 1, ["a"])) == [(2.7, 1.005, 7)]


def test_only_used_leaves_are_scanned(spark, tmp_path):
    from homescore.operators.telemetry import telemetry
    from homescore.schemas import STATION_HISTORY

    spark.createDataFrame([], STATION_HISTORY).write.parquet(str(tmp_path / "h"))
    text = plan(telemetry(spark.read.parquet(str(tmp_path / "h"))).select("serial_num", "sdcd_signal_strength"))
    schema = [line for line in text.splitlines() if "ReadSchema" in line][-1]
    assert "signal_strength" in schema and "tx_packets" not in schema and "diff_bs" not in schema
