"""Shares of a total, and the three ways a device's weight in its home is set."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homescore.config import DEVICE_KEYS, HOME_KEYS, SCORE_A, SCORE_B, SCORE_C, KpiRules, ScoreRules
from homescore.functions.numeric import clipped_ratio


def group_total(df: DataFrame, keys: Sequence[str], value: str, total: str) -> DataFrame:
    """`df` with the sum of `value` over its group.

    Totals are aggregated map-side first and joined back, so a group that holds a large part of all
    rows is summed in pieces and its rows stay spread out: the join side is one row per group, small
    totals are broadcast by size and skewed groups are split at run time. NULL keys form a group.
    """
    renamed = {k: f"__{k}" for k in keys}
    totals = df.groupBy(*keys).agg(F.sum(value).alias(total)).withColumnsRenamed(renamed)
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(renamed[k])) for k in keys])
    return df.join(totals, same, "left").drop(*renamed.values())


def share_of_group(df: DataFrame, keys: Sequence[str], value: str, out: str, places: int | None = None) -> DataFrame:
    share = F.try_divide(F.col(value), F.col("__total"))
    if places is not None:
        share = F.round(share, places)
    return group_total(df, keys, value, "__total").withColumn(out, share).drop("__total")


def share_of_all(df: DataFrame, value: str, out: str, scale: int = 100, places: int | None = None) -> DataFrame:
    """Share of the grand total, read as a scalar so that no row is moved for it."""
    total = df.agg(F.sum(value).alias("total")).scalar()
    share = F.try_divide(F.col(value) * scale, total)
    return df.withColumn(out, F.round(share, places) if places is not None else share)


def _stationary_and_slow(rules: ScoreRules, below: bool) -> Column:
    rate = F.col("avg_phyrate")
    slow = rate < rules.reference_rate if below else rate <= rules.reference_rate
    return slow & (F.col("stationarity") == 1)


def weights_a(
    kpis: DataFrame,
    rules: ScoreRules = SCORE_A,
    per_home: bool = False,
) -> DataFrame:
    """Weights from the link rate alone, as percentages of the whole table (or shares of each home)."""
    rated = kpis.where(F.col("n_phy") > 0).withColumn(
        "label", clipped_ratio(F.col("avg_phyrate"), rules.reference_rate)
    )
    if per_home:
        weighted = share_of_group(rated, ["serial_num"], "label", "weights", 4)
    else:
        weighted = share_of_all(rated, "label", "weights", 100, 4)
    return weighted.drop("label").withColumns(
        {name: F.round(name, 4) for name in ("avg_phyrate", "poor_phyrate")}
    )


def weights_b(
    kpis: DataFrame,
    rules: ScoreRules = SCORE_B,
    kpi_rules: KpiRules = KpiRules(),
) -> DataFrame:
    """Per-home weights in which slow stationary devices count for less.

    The share is taken twice: over devices with a rate, rounded, and again over those that also have
    enough signal readings, rounded. Both roundings belong to the result.
    """
    label = F.when(
        _stationary_and_slow(rules, below=False), F.col("avg_phyrate") / rules.reference_rate
    ).otherwise(1.0)
    rated = (
        kpis.dropna(subset=list(DEVICE_KEYS))
        .where((F.col("n_phy") > 0) & F.col("kept"))
        .withColumn("label", label)
    )
    first = share_of_group(rated, ["serial_num"], "label", "weights", 4).drop("label")
    heard = first.where(F.col("n_rssi") >= kpi_rules.min_readings)
    return share_of_group(heard, ["serial_num"], "weights", "weights", 4).withColumns(
        {name: F.round(name, 4) for name in ("avg_phyrate", "poor_phyrate", "poor_rssi")}
    )


def volume_share(kpis: DataFrame, kpi_rules: KpiRules = KpiRules()) -> DataFrame:
    """Share of each device in the log traffic volume of its home's devices with enough readings."""
    heard = kpis.where(F.col("n_rssi") >= kpi_rules.min_readings)
    return share_of_group(heard, ["serial_num"], "volume", "weights")


def penalise_slow(df: DataFrame, rules: ScoreRules = SCORE_C) -> DataFrame:
    """Cut the weight of slow stationary devices in proportion to their rate."""
    cut = F.col("weights") * F.col("avg_phyrate") / rules.reference_rate
    return df.withColumn(
        "weights", F.when(_stationary_and_slow(rules, below=True), cut).otherwise(F.col("weights"))
    )


def weights_c(
    kpis: DataFrame,
    rules: ScoreRules = SCORE_C,
    kpi_rules: KpiRules = KpiRules(),
) -> DataFrame:
    """Volume shares, cut for slow stationary devices; the home's weights are made to sum to 1 later."""
    shared = volume_share(kpis, kpi_rules).dropna(subset=list(DEVICE_KEYS))
    return shared.where((F.col("n_phy") > 0) & F.col("kept")).transform(penalise_slow, rules)


def renormalise(df: DataFrame, keys: Sequence[str] = HOME_KEYS) -> DataFrame:
    return share_of_group(df, keys, "weights", "weights")

