"""Per-device day features and per-home features over a window of days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from homescore.config import FEATURE_METRICS, WINDOW_FEATURES
from homescore.operators.kpi import grouping_keys, with_key_parts
from homescore.operators.reshape import round_columns


def device_features(readings: DataFrame, metrics: Sequence[str] = FEATURE_METRICS) -> DataFrame:
    """Average and standard deviation of each metric per device, to 2 places."""
    figures = []
    for name in metrics:
        figures.append(F.round(F.avg(name), 2).alias(f"{name}_avg"))
        figures.append(F.round(F.stddev(name), 2).alias(f"{name}_stddev"))
    keys = ("rowkey", "serial_num", "station_mac")
    devices = with_key_parts(readings.groupBy(*grouping_keys(keys)).agg(*figures), keys)
    return devices.select(*keys, *[c for c in devices.columns if c not in keys])


def lowest_n_mean(
    df: DataFrame,
    keys: Sequence[str],
    value: str = "device_score",
    n: int = 5,
    out: str = "lowest_n_scores",
) -> DataFrame:
    """Mean of the n smallest values of each group; groups without any value have no row.

    A rank limited to n lets every map task discard all but its own n smallest values per group
    before the shuffle, so no group is ever gathered whole.
    """
    order = Window.partitionBy(*keys).orderBy(value)
    lowest = (
        df.where(F.col(value).isNotNull())
        .select(*keys, value, F.row_number().over(order).alias("__rank"))
        .where(F.col("__rank") <= n)
    )
    return lowest.groupBy(*keys).agg(F.avg(value).alias(out))


def window_aggregates(
    features: Sequence[str],
    medians: Sequence[str],
    total_volume: bool = False,
    accuracy: int = 10000,
    when: Column | None = None,
) -> list[Column]:
    """Averages, medians and row count of a window; `when` restricts them to one phase."""

    def pick(name: str) -> Column:
        return F.col(name) if when is None else F.when(when, F.col(name))

    counted = F.count("*") if when is None else F.count_if(when)
    figures = [F.avg(pick(name)).alias(name) for name in features]
    figures += [
        F.percentile_approx(pick(name), 0.5, accuracy).alias(f"median_{name}") for name in medians
    ]
    if total_volume:
        figures.append(F.sum(F.exp(pick("volume"))).alias("total_volume"))
    figures.append(counted.alias("count"))
    return figures


def device_window(
    devices: DataFrame,
    features: Sequence[str] = WINDOW_FEATURES,
    median_exclude: Sequence[str] = ("device_score",),
    lowest_n: int | None = 5,
    total_volume: bool = False,
    score: str = "device_score",
    cohort: DataFrame | None = None,
) -> DataFrame:
    """Per-home features over the device rows of a window of days, to 4 places."""
    if cohort is not None:
        devices = devices.join(cohort.select("serial_num"), "serial_num", "left_semi")
    medians = [name for name in features if name not in median_exclude]
    homes = devices.groupBy("serial_num").agg(*window_aggregates(features, medians, total_volume))
    if lowest_n is not None:
        lowest = lowest_n_mean(devices, ["serial_num"], score, lowest_n)
        homes = homes.join(lowest, "serial_num", "left")
    return round_columns(homes, 4)


def home_window(
    homes: DataFrame,
    models: Sequence[str] | None = None,
    per_model: bool = False,
    stations: bool = False,
    cohort: DataFrame | None = None,
) -> DataFrame:
    """Average home score (and station count) over a window of days, to 4 places."""
    if models is not None:
        homes = homes.where(F.col("dg_model_indiv").isin(*models))
    if cohort is not None:
        homes = homes.join(cohort.select("serial_num"), "serial_num", "left_semi")
    keys = ["serial_num", "dg_model_indiv"] if per_model else ["serial_num"]
    figures = [F.avg("home_score").alias("home_score")]
    if stations:
        figures.append(F.avg("num_station").alias("num_station"))
    return round_columns(homes.groupBy(*keys).agg(*figures), 4)

