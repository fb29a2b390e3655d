"""Which homes installed an extender, and when."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homescore.sources.days import as_day, in_days


def homes_with_model(homes: DataFrame, model: str) -> DataFrame:
    return homes.where(F.col("dg_model_indiv") == model).select("serial_num")


def model_snapshot(telemetry: DataFrame, homes: DataFrame, model: str) -> DataFrame:
    """Telemetry of the homes that have a given router model."""
    return telemetry.join(homes_with_model(homes, model), "serial_num", "left_semi")


def _flagged(devices: DataFrame) -> DataFrame:
    """Device rows with their extender flag; rows without any flag count for nothing."""
    flag = F.array_max("Rou_Ext")
    return devices.select("serial_num", "date", flag.alias("Rou_Ext")).where(F.col("Rou_Ext").isNotNull())


def flag_window(devices: DataFrame, start: date | str, count: int, first_offset: int = 0) -> DataFrame:
    """Per home: was any device ever on an extender during the window.

    `first_offset` = 1 leaves out the first day of the window.
    """
    days = in_days(as_day(start) + timedelta(first_offset), count - first_offset)
    return _flagged(devices.where(days)).groupBy("serial_num").agg(F.max("Rou_Ext").alias("Rou_Ext"))


def cohort_by_flags(
    devices: DataFrame,
    before: date | str,
    install: date | str,
    after: date | str,
    count: int,
    after_phase: str = "after",
    first_offset: int = 0,
) -> DataFrame:
    """Homes never on an extender before, on one while installing and on one after.

    All phases are judged in one aggregation; a home without rows in a phase has no flag there and
    fails. `after_phase="install"` repeats the install window as the last phase.
    """
    last = install if after_phase == "install" else after
    phases = [
        in_days(as_day(start) + timedelta(first_offset), count - first_offset)
        for start in (before, install, last)
    ]
    any_phase = phases[0] | phases[1] | phases[2]
    flags = (
        _flagged(devices.where(any_phase))
        .groupBy("serial_num")
        .agg(*[F.max(F.when(phase, F.col("Rou_Ext"))).alias(f"flag_{i}") for i, phase in enumerate(phases)])
    )
    return flags.where("flag_0 = 0 AND flag_1 = 1 AND flag_2 = 1").select("serial_num")


def rolling_cohort(devices: DataFrame, install: date | str, count: int, **options) -> DataFrame:
    """`cohort_by_flags` with adjoining windows of `count` days around the install day."""
    day = as_day(install)
    return cohort_by_flags(devices, day - timedelta(count), day, day + timedelta(count), count, **options)


def cohort_by_month(devices: DataFrame, year: int, month: int, count: int = 30, **options) -> DataFrame:
    """`cohort_by_flags` with windows at the first of the month before, the month and the month after."""
    index = year * 12 + month - 1
    firsts = [date(i // 12, i % 12 + 1, 1) for i in (index - 1, index, index + 1)]
    return cohort_by_flags(devices, *firsts, count, **options)


def homes_with_row_count(homes: DataFrame, matches: Callable[[Column], Column]) -> DataFrame:
    """Homes and days whose number of rows satisfies a condition."""
    return homes.groupBy("serial_num", "date").agg(F.count("*").alias("count")).where(matches(F.col("count")))


def cohort_by_counts(
    homes: DataFrame,
    start: date | str,
    days_before: int = 7,
    days_after: int = 8,
    before: Callable[[Column], Column] = lambda rows: rows == 1,
    after: Callable[[Column], Column] = lambda rows: rows == 2,
) -> DataFrame:
    """Homes with one model row on each day before `start` and two on each day from it on.

    Every requested day must qualify, so a day without data rules a home out. Rows are counted per
    home and day, and the qualifying days per home, without joining the days to each other.
    """
    first = as_day(start)
    earlier = in_days(first - timedelta(days_before), days_before)
    later = in_days(first, days_after)
    daily = (
        homes.where(earlier | later).groupBy("serial_num", "date").agg(F.count("*").alias("rows"))
    )
    rows = F.col("rows")
    return (
        daily.groupBy("serial_num")
        .agg(
            F.count_if(earlier & before(rows)).alias("before_days"),
            F.count_if(later & after(rows)).alias("after_days"),
        )
        .where((F.col("before_days") == days_before) & (F.col("after_days") == days_after))
        .select("serial_num")
    )


def subscribers(df: DataFrame, mdns: Sequence[str] | DataFrame) -> DataFrame:
    """Rows of a subscriber list, given as a short Python list or as a table with an `mdn` column."""
    if isinstance(mdns, DataFrame):
        return df.join(mdns.select("mdn"), "mdn", "left_semi")
    return df.where(F.col("mdn").isin(*mdns))
