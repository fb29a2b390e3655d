"""Per-device quality KPIs, all from one aggregation over the telemetry."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from homescore.config import DEVICE_KEYS, KpiRules
from homescore.functions import parsing
from homescore.functions.numeric import percent

RSSI = "sdcd_signal_strength"
RATE = "sdcd_tx_link_rate"
BAND = "sdcd_connect_type"


def weak_signal(rules: KpiRules) -> Column:
    return reduce(or_, [(F.col(BAND) == band) & (F.col(RSSI) < limit) for band, limit in rules.weak_signal])


def valid_rate(rules: KpiRules) -> Column:
    rate = F.col(RATE)
    return (rate > rules.rate_above) & (rate < rules.rate_below) & ~rate.isin(*rules.rate_excluded)


# Both are parts of the row key, so grouping by the row key already separates them.
KEY_PARTS = {"serial_num": parsing.serial_number, "rk_row_sn": parsing.group_key}


def grouping_keys(keys: Sequence[str]) -> list[str]:
    return [k for k in keys if k not in KEY_PARTS]


def with_key_parts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the parts of the row key named in `keys`: once per group instead of once per reading."""
    return df.withColumns({k: KEY_PARTS[k](F.col("rowkey")) for k in keys if k in KEY_PARTS})


def device_kpis(
    telemetry: DataFrame,
    rules: KpiRules = KpiRules(),
    keys: Sequence[str] = DEVICE_KEYS,
) -> DataFrame:
    """One row per device with signal, rate, stationarity and volume figures and its parents.

    The telemetry is read once. A first aggregation, hashed and combined map-side, leaves a row per
    device, parent, band and signal value with counts and sums: few rows, as there are some hundred dBm
    values, and none of them grows with a device's readings. Percentiles, parents and figures come
    from these. Readings without a row key or station keep no parents. Each figure keeps the conditions under which it exists: `n_rssi` against
    the minimum, `n_phy` above zero, and `kept` for the outlier rule. Devices with a NULL key still count
    in totals; the scoring steps drop them.
    """
    valid, grouped = valid_rate(rules), grouping_keys(keys)
    volumes = {"byte_send", "byte_received"} <= set(telemetry.columns)
    with_parents = "parent_id" in telemetry.columns and "parent_id" not in keys
    named_key = reduce(and_, [F.col(k).isNotNull() for k in grouped])
    apart = [F.when(named_key, F.col("parent_id")).alias("parent_id")] if with_parents else []

    has_signal = F.col(RSSI).isNotNull()
    moved = ("byte_send", "byte_received") if volumes else ()
    cells = telemetry.groupBy(*grouped, *apart, BAND, RSSI).agg(
        F.count(RSSI).alias("n"),
        F.count_if(valid).alias("n_phy"),
        F.sum(F.when(valid, F.col(RATE))).alias("rates"),
        F.count_if(valid & (F.col(RATE) < rules.slow_rate)).alias("n_slow"),
        *[F.sum(F.when(has_signal, F.col(name))).alias(name) for name in moved],
    )
    device = Window.partitionBy(*grouped)
    ranked = cells.withColumns(
        {"upto": F.sum("n").over(device.orderBy(RSSI)), "whole": F.sum("n").over(device)}
    )

    def in_band(i: int) -> Column:
        here = F.col(BAND) == rules.weak_signal[i][0]
        return F.try_divide(F.sum(F.when(here, F.col(RSSI) * F.col("n"))), F.sum(F.when(here, F.col("n"))))

    def percentile(p: float) -> Column:
        """Least signal with a share of `p` of the readings at or below it."""
        return F.min(F.when((F.col("n") > 0) & (F.col("upto") >= F.lit(p) * F.col("whole")), F.col(RSSI)))

    optional = [F.sum(name).alias(name) for name in moved]
    if with_parents:
        # A struct keeps "no parent" as a member, which a plain set would lose.
        optional.append(F.collect_set(F.when(named_key, F.struct("parent_id"))).alias("parents"))
    per_device = ranked.groupBy(*grouped).agg(
        F.sum("n").alias("n_rssi"),
        F.sum(F.when(weak_signal(rules), F.col("n")).otherwise(0)).alias("n_weak"),
        *[in_band(i).alias(f"avg_sig_strength_cat{i + 1}") for i in range(len(rules.weak_signal))],
        F.sum("n_phy").alias("n_phy"),
        F.try_divide(F.sum("rates"), F.sum("n_phy")).alias("avg_phyrate"),
        F.sum("n_slow").alias("n_slow"),
        F.array(*[percentile(p) for p in rules.percentiles]).alias("pct"),
        F.max(RSSI).alias("max_rssi"),
        *optional,
    )
    low, p10, mid, p90 = (F.col("pct")[i] for i in range(4))
    bound = F.least(p10 - rules.spread_factor * (p90 - p10), low)
    kept = F.col("max_rssi") > bound if rules.strict else F.col("max_rssi") >= bound
    named = with_key_parts(per_device, keys).withColumns(
        {
            "poor_rssi": percent(F.col("n_weak"), F.col("n_rssi")),
            "poor_phyrate": percent(F.col("n_slow"), F.col("n_phy")),
            "stationarity": F.when(p90 - mid <= rules.stationary_spread, 1).otherwise(0),
            "kept": F.coalesce(kept, F.lit(False)),
        }
    ).drop("pct", "max_rssi")
    if "byte_send" in named.columns:
        named = named.withColumn("volume", F.ln(F.col("byte_send") + F.col("byte_received")))
    return named


def poor_rssi(kpis: DataFrame, rules: KpiRules = KpiRules(), keys: Sequence[str] = DEVICE_KEYS) -> DataFrame:
    """Share of weak-signal readings of devices with enough readings."""
    extra = [c for c in ("byte_send", "byte_received", "volume") if c in kpis.columns]
    bands = [f"avg_sig_strength_cat{i + 1}" for i in range(len(rules.weak_signal))]
    return kpis.where(F.col("n_rssi") >= rules.min_readings).select(
        *keys, F.col("n_rssi").alias("total_count"), "poor_rssi", *bands, *extra
    )


def poor_phyrate(kpis: DataFrame, keys: Sequence[str] = DEVICE_KEYS) -> DataFrame:
    """Average link rate and share of slow readings, over valid rates only."""
    return kpis.where(F.col("n_phy") > 0).select(
        *keys, F.col("n_phy").alias("total_count"), "avg_phyrate", "poor_phyrate"
    )


def stationarity(kpis: DataFrame, keys: Sequence[str] = DEVICE_KEYS) -> DataFrame:
    """1 for devices whose signal hardly varies above its median; only devices the outlier rule keeps."""
    return kpis.where("kept").select(*keys, "stationarity")


def stationarity_rows(
    telemetry: DataFrame,
    rules: KpiRules = KpiRules(strict=False),
    keys: Sequence[str] = DEVICE_KEYS,
) -> DataFrame:
    """Readings that survive the outlier rule with interpolated percentiles, plus their device's flag.

    Of the two bounds the one that drops fewer readings applies. Both drop everything below them, so
    that is always the lower one and no counting is needed. Percentiles come from counts per signal
    value; the readings then meet one row per device, where a device with very many of them is split
    at run time.
    """
    points = F.array(*[F.lit(p) for p in rules.percentiles])
    low, p10, mid, p90 = (F.col("pct")[i] for i in range(4))
    grouped = grouping_keys(keys)
    readings = telemetry.dropna(subset=[*grouped, RSSI])
    bounds = (
        readings.groupBy(*grouped, RSSI)
        .agg(F.count("*").alias("n"))
        .groupBy(*grouped)
        .agg(F.percentile(RSSI, points, F.col("n")).alias("pct"))
        .select(
            *grouped,
            F.least(p10 - rules.spread_factor * (p90 - p10), low).alias("bound"),
            F.when(F.abs(p90 - mid) <= rules.stationary_spread, 1).otherwise(0).alias("stationarity"),
        )
    )
    keep = F.col(RSSI) > F.col("bound") if rules.strict else F.col(RSSI) >= F.col("bound")
    return readings.join(bounds, grouped).where(keep).drop("bound")
