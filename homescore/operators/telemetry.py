"""Station history to flat wireless telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from homescore.config import KpiRules
from homescore.functions import parsing as P
from homescore.operators.reshape import rename_and_cast
from homescore.schemas import STATION_ROOT

# Source field -> (type, column) of the numeric metrics kept per reading.
METRIC_FIELDS = {
    "airtime_util": ("long", "airtime"),
    "bw": ("long", "bandwidth"),
    "channel": ("long", "channel_freq"),
    "tx_packets": ("long", "trans_packets"),
    "rx_packets": ("long", "recv_packets"),
    "snr": ("long", "snr"),
    "signal_strength": ("long", "sdcd_signal_strength"),
    "diff_bs": ("long", "byte_send"),
    "diff_br": ("long", "byte_received"),
    "connect_state": ("long", "connect_state"),
    "diff_tx_packets": ("long", "diff_tx_packets"),
    "diff_rx_packets": ("long", "diff_rx_packets"),
}


def telemetry(
    history: DataFrame,
    complete: bool = False,
    rules: KpiRules = KpiRules(),
    root: str = STATION_ROOT,
) -> DataFrame:
    """Wireless readings with parsed keys, rates, signal and byte counts.

    Struct leaves are read by path, so only the leaves used here are scanned. `complete` keeps
    only readings that have both a signal strength and a link rate.
    """
    leaf = {name: F.col(f"{root}.{name}") for name in _leaves(history, root)}
    key = F.col("rowkey")
    parsed = history.select(
        "rowkey",
        P.serial_number(key).alias("serial_num"),
        P.group_key(key).alias("rk_row_sn"),
        P.row_prefix(key).alias("rk_row"),
        leaf["station_mac"].alias("station_mac"),
        leaf["parent_id"].alias("parent_id"),
        P.lenient_long(leaf["signal_strength"]).alias("sdcd_signal_strength"),
        P.strip_unit(leaf["tx_link_rate"]).alias("sdcd_tx_link_rate"),
        P.strip_unit(leaf["link_rate"]).alias("sdcd_link_rate"),
        P.band(leaf["connect_type"]).alias("sdcd_connect_type"),
        P.lenient_long(leaf["diff_bs"]).alias("byte_send"),
        P.lenient_long(leaf["diff_br"]).alias("byte_received"),
    ).where(F.col("sdcd_connect_type").isin(*rules.bands))
    if complete:
        parsed = parsed.dropna(subset=["sdcd_signal_strength", "sdcd_tx_link_rate"])
    return parsed


def metric_telemetry(history: DataFrame, rules: KpiRules = KpiRules(), root: str = STATION_ROOT) -> DataFrame:
    """Wireless readings with every numeric metric, for the per-device feature table."""
    key = F.col("rowkey")
    leaves = history.select(
        "rowkey",
        P.serial_number(key).alias("serial_num"),
        P.epoch_ms(F.col("ts")).alias("time"),
        P.remove_unit(F.col(f"{root}.tx_link_rate")).alias("sdcd_tx_link_rate"),
        P.strip_unit(F.col(f"{root}.link_rate")).alias("sdcd_link_rate"),
        P.band(F.col(f"{root}.connect_type")).alias("sdcd_connect_type"),
        F.col(f"{root}.station_mac").alias("station_mac"),
        F.col(f"{root}.parent_id").alias("parent_id"),
        *[F.col(f"{root}.{name}").alias(f"raw_{name}") for name in METRIC_FIELDS],
    ).where(F.col("sdcd_connect_type").isin(*rules.bands))
    named = rename_and_cast(leaves, {f"raw_{name}": target for name, target in METRIC_FIELDS.items()})
    return named.drop(*[f"raw_{name}" for name in METRIC_FIELDS])


def _leaves(df: DataFrame, root: str) -> list[str]:
    return df.select(f"{root}.*").columns
