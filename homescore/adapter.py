"""Views of the driver's tables in the shape of the library's inputs.

The tables hold no telemetry, so suppliers stand for homes, line items for readings, parts for the
routers and extenders, and users and their events for homes and daily device rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from homescore.schemas import GROUP_ROOT, STATION, STATION_ROOT

DELIVERED = "202401010000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def serial(key: Column) -> Column:
    return F.concat(F.lit("SN"), F.lpad(key.cast("string"), 9, "0"))


def _home_key(key: Column) -> Column:
    prefix = F.concat(F.lit("R"), F.lpad((key % 1000).cast("string"), 3, "0"))
    return F.concat_ws("-", prefix, serial(key))


def _reading() -> dict[str, Column]:
    line, quantity = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    device = F.col("l_suppkey") * 100 + line * 10 + (F.col("l_linestatus") == "F").cast("int")
    flag = F.col("l_returnflag")
    return {
        "serial_num": serial(F.col("l_suppkey")),
        "rk_row_sn": _home_key(F.col("l_suppkey")),
        "rowkey": F.concat_ws("-", _home_key(F.col("l_suppkey")), F.lit(DELIVERED)),
        "station_mac": F.concat(F.lit("M"), device.cast("string")),
        "parent_id": F.concat(F.lit("P"), F.col("l_partkey").cast("string")),
        "band": F.when(flag == "A", "2.").when(flag == "N", "5G").otherwise("6G"),
        "rssi": F.when(line % 2 == 0, -45 - quantity).otherwise(-66 - F.shiftright(quantity, 2)).cast("bigint"),
        "rate": F.when(line == 3, 7 + F.col("l_partkey") % 20)
        .otherwise(F.floor(F.col("l_extendedprice") / 40))
        .cast("bigint"),
        "sent": F.floor("l_extendedprice").cast("bigint"),
        "received": quantity.cast("bigint") * 100,
    }


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat readings, all wireless and complete."""
    r = _reading()
    return table(spark, sf_dir, "lineitem").select(
        r["rowkey"].alias("rowkey"),
        r["rk_row_sn"].alias("rk_row_sn"),
        r["serial_num"].alias("serial_num"),
        r["station_mac"].alias("station_mac"),
        r["parent_id"].alias("parent_id"),
        r["rssi"].alias("sdcd_signal_strength"),
        r["rate"].alias("sdcd_tx_link_rate"),
        r["band"].alias("sdcd_connect_type"),
        r["sent"].alias("byte_send"),
        r["received"].alias("byte_received"),
    )


# The leaves that scoring reads.
SCORED_FIELDS = (
    "station_mac",
    "parent_id",
    "connect_type",
    "tx_link_rate",
    "link_rate",
    "signal_strength",
    "diff_bs",
    "diff_br",
)


def station_history(spark: SparkSession, sf_dir: str, fields: Sequence[str] | None = None) -> DataFrame:
    """Nested readings as text, with wired devices, unreadable rates and missing signals among them.

    `fields` names the leaves to build; a stored table would leave the others unread.
    """
    r = _reading()
    discount, line = F.col("l_discount"), F.col("l_linenumber")
    mark = F.when(discount == 0.01, ".5").when(discount == 0.02, " ").otherwise("")
    tx = F.when(discount == 0.03, "autoMbps").otherwise(
        F.concat(r["rate"].cast("string"), mark, F.lit("Mbps"))
    )
    signal = F.when((discount == 0.04) & (F.col("l_tax") == 0.04), "n/a").otherwise(r["rssi"].cast("string"))
    kind = (
        F.when((line == 7) & (F.col("l_linestatus") == "O"), "Ethernet")
        .when(F.col("l_returnflag") == "A", "2.4GHz")
        .when(F.col("l_returnflag") == "N", "5GHz")
        .otherwise("6GHz")
    )

    def text(value: Column) -> Column:
        return value.cast("string")

    quantity = F.col("l_quantity").cast("int")
    leaves = [
        r["station_mac"].alias("station_mac"),
        r["parent_id"].alias("parent_id"),
        kind.alias("connect_type"),
        tx.alias("tx_link_rate"),
        F.concat(text(r["rate"] + quantity), F.lit("Mbps")).alias("link_rate"),
        signal.alias("signal_strength"),
        text(quantity).alias("snr"),
        text(quantity).alias("airtime_util"),
        text(line).alias("bw"),
        text(line).alias("channel"),
        text(F.col("l_partkey")).alias("tx_packets"),
        text(F.col("l_orderkey")).alias("rx_packets"),
        text(quantity).alias("diff_tx_packets"),
        text(line).alias("diff_rx_packets"),
        text(r["sent"]).alias("diff_bs"),
        text(r["received"]).alias("diff_br"),
        text(F.lit(1)).alias("connect_state"),
    ]
    names = STATION.fieldNames()
    station = F.struct(*[leaves[i] for i, name in enumerate(names) if fields is None or name in fields])
    record = F.struct(
        r["rowkey"].alias("rowkey"),
        (F.unix_millis(F.col("l_shipdate").cast("timestamp")) + F.col("l_orderkey") % 1000).alias("ts"),
        station.alias(STATION_ROOT),
    )
    # Built once per row by a generator: as plain columns these long expressions would be copied into
    # every filter and parse step above them, and the generated code would grow past what the JVM compiles.
    return table(spark, sf_dir, "lineitem").select(F.inline(F.array(record)))


def group_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested group records: each part a home met, as a router or extender, and one unused member."""
    # Moved by part before they are made distinct, so that a part table too large to copy moves no pair again.
    # The number is named because pairs are short: partitions joined to the usual bytes would hold millions.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").repartition(parts, "l_partkey").distinct()
    part = table(spark, sf_dir, "part")
    gateway = F.concat(F.lit("G"), F.col("l_suppkey").cast("string"))
    member = F.struct(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("mac"),
        F.when(F.col("p_type") != "ECONOMY", F.col("p_brand")).alias("model"),
        F.when(F.col("p_size") % 2 == 0, gateway).alias("parent_mac"),
        F.concat(F.lit("fw"), F.col("p_size").cast("string")).alias("fw"),
    )
    spare = F.struct(
        F.concat(F.lit("X"), F.col("l_partkey").cast("string")).alias("mac"),
        F.lit("spare").alias("model"),
        F.lit(None).cast("string").alias("parent_mac"),
        F.lit("fw0").alias("fw"),
    )
    return pairs.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        _home_key(F.col("l_suppkey")).alias("rowkey"), F.array(member, spare).alias(GROUP_ROOT)
    )


def subscriber_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as subscribers; some homes have a second subscriber, some none."""
    supplier = table(spark, sf_dir, "supplier")
    number, nation = serial(F.col("s_suppkey")), F.col("s_nationkey").cast("string")
    status = F.when(F.col("s_acctbal") > 0, "INSTALL COMPLETE").otherwise("PENDING")

    def row(name: Column) -> Column:
        return F.struct(
            name.alias("mdn_5g"), number.alias("serialnumber"), nation.alias("cust_id"), status.alias("status")
        )

    second = F.when(F.col("s_acctbal") > 9000, row(F.concat(F.col("s_name"), F.lit("b"))))
    return supplier.select(F.inline(F.array_compact(F.array(row(F.col("s_name")), second))))


def _user(key: Column) -> Column:
    return F.concat(F.lit("H"), key.cast("string"))


def device_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily device rows: one per event, its user the home and its type the model.

    Figures are multiples of small powers of two, so that their sums do not depend on row order.
    """
    value, event = F.floor(F.col("value") * 64) / 64, F.col("event_id")
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf_dir, "events").select(
        F.to_date("ts").alias("date"),
        _user(F.col("user_id")).alias("serial_num"),
        F.concat(F.lit("D"), F.col("user_id").cast("string")).alias("mdn"),
        F.concat(F.lit("C"), F.col("user_id").cast("string")).alias("cust_id"),
        F.concat(F.lit("M"), event.cast("string")).alias("station_mac"),
        (5 + value * 6).alias("avg_phyrate"),
        F.least(value / 2, F.lit(100.0)).alias("poor_phyrate"),
        k.alias("poor_rssi"),
        (100 - F.least(value, F.lit(100.0))).alias("device_score"),
        (k / 128).alias("weights"),
        (event % 2).cast("double").alias("stationarity"),
        (F.lit(2.0) + k / 32).alias("volume"),
        F.when(kind.isin("view", "click"), -40 - k / 2).alias("avg_sig_strength_cat1"),
        F.when(kind.isin("click", "signup", "purchase"), -35 - k / 2).alias("avg_sig_strength_cat2"),
        F.when(kind == "error", -30 - k / 2).alias("avg_sig_strength_cat3"),
        F.array(kind).alias("dg_model"),
        F.array((kind == "purchase").cast("int")).alias("Rou_Ext"),
        F.concat(F.lit("fw"), (event % 7).cast("string")).alias("firmware"),
    )


def home_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily home rows, one per model of the home that day."""
    days = device_days(spark, sf_dir)
    model = F.col("dg_model")[0]
    return (
        days.groupBy("date", "serial_num", "mdn", "cust_id", model.alias("dg_model_indiv"))
        .agg(
            (F.floor(F.avg("device_score") * 64) / 64).alias("home_score"),
            F.count("*").alias("num_station"),
            F.collect_set("dg_model").alias("dg_model"),
            F.collect_set("Rou_Ext").alias("Rou_Ext"),
        )
    )
