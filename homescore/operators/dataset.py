"""Training rows of homes that installed an extender, and the population to be scored."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homescore.config import WINDOW_FEATURES
from homescore.operators.features import device_window, home_window, lowest_n_mean, window_aggregates
from homescore.operators.reshape import round_columns, stamp_date
from homescore.sources.days import as_day, in_days


def before_after_set(
    devices: DataFrame,
    homes: DataFrame | None,
    cohort: DataFrame | None,
    before: date | str,
    after: date | str,
    count: int,
    features: Sequence[str] = WINDOW_FEATURES,
    lowest_n: int | None = 5,
    total_volume: bool = True,
    score: str = "device_score",
) -> DataFrame:
    """Features before, target scores after, for homes seen in both windows.

    Both windows are aggregated in the same pass over the device rows. `homes=None` leaves out the
    home scores, `lowest_n=None` the lowest-n scores.
    """
    earlier, later = in_days(before, count), in_days(after, count)
    seen = devices.where(earlier | later)
    if cohort is not None:
        seen = seen.join(cohort.select("serial_num"), "serial_num", "left_semi")
    medians = [name for name in features if name != score]
    rows = (
        seen.groupBy("serial_num")
        .agg(
            *window_aggregates(features, medians, total_volume, when=earlier),
            F.avg(F.when(later, F.col(score))).alias("target_avg_device_score"),
            F.count_if(later).alias("__later"),
        )
        .where("count > 0 AND __later > 0")
        .drop("__later")
        .withColumnRenamed(score, "avg_device_score")
    )
    if lowest_n is not None:
        rows = rows.join(_lowest_phases(seen, earlier, later, score, lowest_n), "serial_num", "left")
    rows = round_columns(rows, 4)
    if homes is not None:
        rows = rows.join(_home_phases(homes, before, after, count, cohort), "serial_num")
    return rows


def _lowest_phases(seen: DataFrame, earlier: Column, later: Column, score: str, n: int) -> DataFrame:
    """Lowest-n mean of both windows; a day in both counts in both."""
    phases = F.array_compact(F.array(F.when(earlier, "before"), F.when(later, "after")))
    each = seen.select("serial_num", score, F.explode(phases).alias("phase"))
    lowest = lowest_n_mean(each, ["serial_num", "phase"], score, n)

    def of(phase: str) -> Column:
        return F.max(F.when(F.col("phase") == phase, F.col("lowest_n_scores")))

    return lowest.groupBy("serial_num").agg(
        of("before").alias("before_lowest_n_scores"), of("after").alias("target_lowest_n_scores")
    )


def _home_phases(
    homes: DataFrame, before: date | str, after: date | str, count: int, cohort: DataFrame | None
) -> DataFrame:
    """Average home score in both windows from one scan, for homes with rows in both."""
    earlier, later = in_days(before, count), in_days(after, count)
    rows = homes.where(earlier | later)
    if cohort is not None:
        rows = rows.join(cohort.select("serial_num"), "serial_num", "left_semi")
    phases = rows.groupBy("serial_num").agg(
        F.avg(F.when(earlier, F.col("home_score"))).alias("before_home_score"),
        F.avg(F.when(later, F.col("home_score"))).alias("after_home_score"),
        F.count_if(earlier).alias("__before"),
        F.count_if(later).alias("__after"),
    )
    present = phases.where("__before > 0 AND __after > 0").drop("__before", "__after")
    return round_columns(present, 4)


def install_set(
    devices: DataFrame,
    homes: DataFrame,
    cohort: DataFrame,
    start: date | str,
    routers: Sequence[str],
    days_before: int = 7,
    days_after: int = 8,
    features: Sequence[str] = WINDOW_FEATURES,
    lowest_n: int = 5,
) -> DataFrame:
    """Training rows of homes whose extender was found by row counts: one row per home and router model.

    The start day itself belongs to neither window.
    """
    first = as_day(start)
    before = in_days(first - timedelta(days_before), days_before)
    after = in_days(first + timedelta(1), days_after - 1)
    inputs = device_window(devices.where(before), features, ("device_score",), lowest_n, cohort=cohort)
    earlier = home_window(homes.where(before), routers, True, True, cohort).withColumnRenamed(
        "home_score", "before_home_score"
    )
    later = home_window(homes.where(after), routers, cohort=cohort).withColumnRenamed(
        "home_score", "after_home_score"
    )
    rows = inputs.join(earlier, "serial_num").join(later, "serial_num")
    return stamp_date(rows, str(first), "date_string").withColumn(
        "date_string", F.col("date_string").cast("string")
    )


def router_population(
    devices: DataFrame,
    homes: DataFrame,
    day: date | str,
    count: int = 7,
    routers: Sequence[str] | None = None,
    features: Sequence[str] = WINDOW_FEATURES,
    median_exclude: Sequence[str] = (),
    lowest_n: int = 5,
) -> DataFrame:
    """Features of every home over the days before `day`.

    By default every feature has a median, the device score too.
    """
    window = in_days(as_day(day) - timedelta(count), count)
    inputs = device_window(
        devices.where(window), features, median_exclude, lowest_n, total_volume=True
    ).withColumnsRenamed({"device_score": "avg_device_score", "lowest_n_scores": "before_lowest_n_scores"})
    scores = home_window(homes.where(window), routers).withColumnRenamed("home_score", "before_home_score")
    return inputs.join(scores, "serial_num")


def with_increment(
    df: DataFrame, after: str = "after_home_score", before: str = "before_home_score"
) -> DataFrame:
    return df.withColumn("score_increment", F.round(F.col(after) - F.col(before), 4))
