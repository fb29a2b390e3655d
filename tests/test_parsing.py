from pyspark.sql import functions as F

from homescore.functions import parsing as P


def one_column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_lenient_long_reads_what_a_number_looks_like(spark):
    values = ["72", "72.2", " 866 ", "-45.9", "+3", "abc", "", "1e3", "12a", None, "7.", "99999999999999999999"]
    expected = [72, 72, 866, -45, 3, None, None, None, None, None, 7, None]
    assert one_column(spark, values, P.lenient_long) == expected


def test_units_are_cut_or_replaced(spark):
    values = ["72.2Mbps", "866 Mbps", "autoMbps", "Mbps", "ab"]
    assert one_column(spark, values, P.strip_unit) == [72, 866, None, None, None]
    assert one_column(spark, values, P.remove_unit) == [72, 866, None, None, None]
    assert one_column(spark, ["100Kbps"], P.strip_unit) == [100]
    assert one_column(spark, ["100Kbps"], P.remove_unit) == [None]


def test_row_key_parts(spark):
    key = "ABCD-SERIAL0001-202401010000"
    assert one_column(spark, [key, "ABCD-short"], P.serial_number) == ["SERIAL0001", ""]
    assert one_column(spark, [key], P.short_serial) == ["SERIAL"]
    assert one_column(spark, [key], P.group_key) == ["ABCD-SERIAL0001"]
    assert one_column(spark, ["5GHz", "2.4GHz", None], P.band) == ["5G", "2.", None]


def test_epoch_is_cut_to_seconds(spark):
    df = spark.createDataFrame([(1704067201999,)], "ts bigint")
    text = F.date_format(P.epoch_ms(F.col("ts")), "yyyy-MM-dd HH:mm:ss.SSS")
    assert df.select(text).first()[0] == "2024-01-01 00:00:01.000"
