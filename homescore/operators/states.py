"""Daily states of homes that add up: a window of days merges a few small rows a home instead of its device rows."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from homescore.config import WINDOW_FEATURES
from homescore.operators.medians import medians, value_counts, with_medians
from homescore.operators.reshape import round_columns
from homescore.sources.days import as_day, in_days


def device_states(
    devices: DataFrame, features: Sequence[str] = WINDOW_FEATURES, score: str = "device_score", lowest_n: int = 5
) -> DataFrame:
    """One row for each home and day: rows, sum and number of every feature's values, total volume, lowest scores.

    `lowest` holds at most `lowest_n` scores. Any features may be asked for later that are here, and any
    number of lowest scores up to `lowest_n`.
    """
    keys = ["serial_num", "date"]
    figures = [F.count("*").alias("rows")]
    for name in features:
        figures += [F.sum(name).alias(f"sum_{name}"), F.count(name).alias(f"n_{name}")]
    if "volume" in features:
        figures.append(F.sum(F.exp("volume")).alias("total_volume"))
    order = Window.partitionBy(*keys).orderBy(score)
    low = (
        devices.where(F.col(score).isNotNull()).select(*keys, F.col(score).alias("score"), F.row_number().over(order).alias("rank"))
        .where(F.col("rank") <= lowest_n)
    )
    lowest = low.groupBy(*keys).agg(F.sort_array(F.collect_list("score")).alias("lowest"))
    return devices.groupBy(*keys).agg(*figures).join(lowest, keys, "left")


def value_states(devices: DataFrame, features: Sequence[str] = WINDOW_FEATURES) -> DataFrame:
    """serial_num, date, name, value and n: how often each home had a value of a feature on a day."""
    return value_counts(devices, ["serial_num", "date"], features)


def home_states(homes: DataFrame) -> DataFrame:
    """One row for each home, router model and day: sums and numbers of scores and stations."""
    return homes.groupBy("serial_num", "dg_model_indiv", "date").agg(
        F.sum("home_score").alias("sum_home_score"), F.count("home_score").alias("n_home_score"),
        F.sum("num_station").alias("sum_num_station"), F.count("num_station").alias("n_num_station"),
    )


def _mean(name: str) -> Column:
    return F.try_divide(F.sum(f"sum_{name}"), F.sum(f"n_{name}"))


def device_window(
    states: DataFrame,
    values: DataFrame,
    features: Sequence[str] = WINDOW_FEATURES,
    median_exclude: Sequence[str] = ("device_score",),
    lowest_n: int | None = 5,
    total_volume: bool = False,
    cohort: DataFrame | None = None,
) -> DataFrame:
    """The figures of `features.device_window` from the states of the days of a window, with exact medians."""
    if cohort is not None:
        members = cohort.select("serial_num")
        states, values = (df.join(members, "serial_num", "left_semi") for df in (states, values))
    with_median = [name for name in features if name not in median_exclude]
    figures = [_mean(name).alias(name) for name in features]
    if total_volume:
        figures.append(F.sum("total_volume").alias("total_volume"))
    figures.append(F.sum("rows").alias("count"))
    if lowest_n is not None:
        # a few scores a day of the window
        every = F.slice(F.sort_array(F.flatten(F.collect_list("lowest"))), 1, lowest_n)
        figures.append(F.aggregate(every, F.lit(0.0), lambda s, x: s + x, lambda s: F.try_divide(s, F.size(every))).alias("lowest_n_scores"))
    homes = states.groupBy("serial_num").agg(*figures)
    if with_median:
        found = medians(values.where(F.col("name").isin(*with_median)).select("serial_num", "name", "value", "n"), ["serial_num"])
        homes = with_medians(homes, found, ["serial_num"], with_median)
    return round_columns(homes, 4)


def home_window(
    states: DataFrame,
    models: Sequence[str] | None = None,
    per_model: bool = False,
    stations: bool = False,
    cohort: DataFrame | None = None,
) -> DataFrame:
    """The figures of `features.home_window` from the states of the days of a window."""
    if models is not None:
        states = states.where(F.col("dg_model_indiv").isin(*models))
    if cohort is not None:
        states = states.join(cohort.select("serial_num"), "serial_num", "left_semi")
    keys = ["serial_num", "dg_model_indiv"] if per_model else ["serial_num"]
    figures = [_mean(name).alias(name) for name in ("home_score", *(["num_station"] if stations else []))]
    return round_columns(states.groupBy(*keys).agg(*figures), 4)


def router_population(
    states: DataFrame,
    values: DataFrame,
    homes: DataFrame,
    day: date | str,
    count: int = 7,
    routers: Sequence[str] | None = None,
    features: Sequence[str] = WINDOW_FEATURES,
    median_exclude: Sequence[str] = (),
    lowest_n: int = 5,
) -> DataFrame:
    """`dataset.router_population` from the states of the days before `day`."""
    window = in_days(as_day(day) - timedelta(count), count)
    inputs = device_window(
        states.where(window), values.where(window), features, median_exclude, lowest_n, total_volume=True
    ).withColumnsRenamed({"device_score": "avg_device_score", "lowest_n_scores": "before_lowest_n_scores"})
    scores = home_window(homes.where(window), routers).withColumnRenamed("home_score", "before_home_score")
    return inputs.join(scores, "serial_num")
