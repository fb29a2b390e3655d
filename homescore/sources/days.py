"""Daily tables: windows of days, latest snapshots, missing days."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = "date"


def as_day(day: date | str) -> date:
    return date.fromisoformat(day) if isinstance(day, str) else day


def day_list(start: date | str, count: int) -> list[date]:
    """`count` days from `start` on."""
    first = as_day(start)
    return [first + timedelta(i) for i in range(count)]


def in_days(start: date | str, count: int, column: str = DAY) -> Column:
    """Condition for `count` days from `start` on; prunes partitions of a table partitioned by day."""
    first = as_day(start)
    last = first + timedelta(count - 1)
    return F.col(column).between(F.lit(first), F.lit(last))


def window_of_days(
    df: DataFrame,
    start: date | str,
    count: int,
    on_missing: str = "skip",
    dedup: bool = False,
    column: str = DAY,
) -> DataFrame:
    """Rows of a run of days in one scan.

    Days without data are skipped, or raise with `on_missing="error"`. `dedup` removes repeated rows
    within each day.
    """
    if on_missing == "error":
        missing = days_without_rows(df, start, count, column)
        if missing:
            raise FileNotFoundError("no data for " + ", ".join(str(d) for d in missing))
    rows = df.where(in_days(start, count, column))
    return rows.dropDuplicates() if dedup else rows


def missing_days(df: DataFrame, start: date | str, count: int, column: str = DAY) -> DataFrame:
    """The requested days that have no rows, one row each."""
    first = as_day(start)
    wanted = df.sparkSession.range(count).select(
        F.date_add(F.lit(first), F.col("id").cast("int")).alias(column)
    )
    found = df.where(in_days(first, count, column)).select(column).distinct()
    return wanted.join(found, column, "left_anti")


def days_without_rows(df: DataFrame, start: date | str, count: int, column: str = DAY) -> list[date]:
    """`missing_days` on the driver; at most `count` dates."""
    return sorted(row[0] for row in missing_days(df, start, count, column).collect())


def days_to_backfill(df: DataFrame, today: date | str, back: int, column: str = DAY) -> list[date]:
    """Of the `back` days before `today`, those without output yet, latest first."""
    first = as_day(today) - timedelta(back)
    return days_without_rows(df, first, back, column)[::-1]


def latest_snapshot(
    df: DataFrame, day: date | str, max_back: int, min_back: int = 0, column: str = DAY
) -> DataFrame:
    """Rows of the newest day between `max_back` and `min_back` days before `day`.

    The day is a scalar subquery, so the scan itself is still pruned to one partition.
    """
    first = as_day(day) - timedelta(max_back)
    window = in_days(first, max_back - min_back + 1, column)
    newest = df.where(window).agg(F.max(column).alias("newest")).scalar()
    return df.where(window & (F.col(column) == newest))


def latest_day(df: DataFrame, day: date | str, max_back: int, min_back: int = 0, column: str = DAY) -> date:
    """Newest day with data in the look-back range; raises when there is none."""
    first = as_day(day) - timedelta(max_back)
    newest = df.where(in_days(first, max_back - min_back + 1, column)).agg(F.max(column)).first()[0]
    if newest is None:
        raise FileNotFoundError(f"no snapshot from {max_back} to {min_back} days before {as_day(day)}")
    return newest


def newest_for_each(
    df: DataFrame, targets: Sequence[date | str], max_back: int, min_back: int = 0, column: str = DAY
) -> dict[date, date]:
    """For each target day the newest day with data between `max_back` and `min_back` days before it.

    Target days without one are left out. Only days come to the driver.
    """
    wanted = sorted(map(as_day, targets))
    if not wanted:
        return {}
    first, last = wanted[0] - timedelta(max_back), wanted[-1] - timedelta(min_back)
    held = sorted(r[0] for r in df.where(in_days(first, (last - first).days + 1, column)).select(column).distinct().collect())
    chosen = {}
    for day in wanted:
        fitting = [d for d in held if day - timedelta(max_back) <= d <= day - timedelta(min_back)]
        if fitting:
            chosen[day] = fitting[-1]
    return chosen


def as_of(
    df: DataFrame, targets: Sequence[date | str], max_back: int, min_back: int = 0, column: str = DAY, out: str = "as_of"
) -> DataFrame:
    """The newest snapshot of each of many target days, in one scan: its rows with the target day as `out`.

    A snapshot that serves several days gives its rows for each of them; the scan is pruned to the
    snapshots that serve any. A target day without a snapshot in its look-back range has no rows.
    """
    chosen = newest_for_each(df, targets, max_back, min_back, column)
    served: dict[date, list[date]] = {}
    for day, snapshot in chosen.items():
        served.setdefault(snapshot, []).append(day)
    if not served:
        return df.select("*", F.lit(None).cast("date").alias(out)).where("false")
    days_of = F.coalesce(*[F.when(F.col(column) == F.lit(snapshot), F.array(*map(F.lit, days))) for snapshot, days in served.items()])
    return df.where(F.col(column).isin([F.lit(d) for d in served])).select("*", F.explode(days_of).alias(out))


def snapshot_or_fallback(
    df: DataFrame, day: date | str, fallback: date | str, column: str = DAY
) -> DataFrame:
    """Rows of `day`, or of the fixed fallback day when `day` has none."""
    days = [F.lit(as_day(day)), F.lit(as_day(fallback))]
    candidates = F.col(column).isin(*days)
    chosen = df.where(candidates).agg(
        F.coalesce(F.max(F.when(F.col(column) == days[0], days[0])), days[1]).alias("chosen")
    )
    return df.where(candidates & (F.col(column) == chosen.scalar()))


def path_of(source: Column) -> Column:
    """A file's path as Spark reports it, with its URI escapes undone."""
    return F.try_url_decode(F.replace(source, F.lit("+"), F.lit("%2B")))


def under(source: Column, path: str) -> Column:
    """Whether a file is `path` or lies in that folder; schemes and hosts are left aside."""
    plain = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", path).rstrip("/")
    return F.endswith(source, F.lit(plain)) | F.contains(source, F.lit(plain + "/"))


def existing_paths(spark: SparkSession, pattern: str, names: Sequence[str]) -> list[str]:
    """Of the paths that the names give in `pattern` ('.../{}/...'), those with files, from one listing."""
    paths = [pattern.format(name) for name in names]
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(pattern.format("{" + ",".join(names) + "}")).select("path")
        file = path_of(F.col("path"))
        which = F.coalesce(*[F.when(under(file, p), F.lit(p)) for p in paths])
        found = {row[0] for row in files.select(which.alias("found")).where("found is not null").distinct().collect()}
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        found = set()
    return [p for p in paths if p in found]


def table_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at `path`, None before its first day is written."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
