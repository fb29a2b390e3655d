"""Explicit schemas of the input tables."""

from __future__ import annotations

from pyspark.sql import types as T

STATION_ROOT = "Station_Data_connect_data"
GROUP_ROOT = "Group_Data_sys_info"


def _texts(names: tuple[str, ...]) -> list[T.StructField]:
    return [T.StructField(name, T.StringType()) for name in names]


# The fields of the inputs.
STATION_FIELDS = (
    "station_mac",
    "parent_id",
    "connect_type",
    "tx_link_rate",
    "link_rate",
    "signal_strength",
    "snr",
    "airtime_util",
    "bw",
    "channel",
    "tx_packets",
    "rx_packets",
    "diff_tx_packets",
    "diff_rx_packets",
    "diff_bs",
    "diff_br",
    "connect_state",
)
GROUP_FIELDS = ("mac", "model", "parent_mac", "fw")
MAP_FIELDS = ("mdn_5g", "serialnumber", "cust_id", "status")

STATION = T.StructType(_texts(STATION_FIELDS))
STATION_HISTORY = T.StructType(
    [
        T.StructField("rowkey", T.StringType()),
        T.StructField("ts", T.LongType()),
        T.StructField(STATION_ROOT, STATION),
    ]
)

GROUP_MEMBER = T.StructType(_texts(GROUP_FIELDS))
DEVICE_GROUPS = T.StructType(
    [
        T.StructField("rowkey", T.StringType()),
        T.StructField(GROUP_ROOT, T.ArrayType(GROUP_MEMBER)),
    ]
)

SUBSCRIBER_MAP = T.StructType(_texts(MAP_FIELDS))


def dated(schema: T.StructType) -> T.StructType:
    """The schema with the day that tables are partitioned by."""
    return T.StructType([*schema.fields, T.StructField("date", T.DateType())])
