"""Writers for daily tables, windowed datasets and report extracts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from homescore.sources.days import as_day, table_or_none


def overwrite_days(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = ("date",),
    files: int | None = None,
    days: Sequence[date | str] = (),
) -> None:
    """Replace the partitions present in `df`, so that a day can be written again.

    `days` names the days (of the first partition column) that `df` stands for: those for which it has
    no row end up empty. Without `files` the rows are rebalanced by size; with it they go to that many
    tasks.
    """
    stored = _files_of_days(df.sparkSession, path, partition_by[0], days)
    schema = df.drop(*partition_by).schema
    sized = df.hint("rebalance") if files is None else df.repartition(files)
    (
        sized.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )
    # a day that was written has none of its old files left
    for day in sorted({day for day, _ in stored & _files_of_days(df.sparkSession, path, partition_by[0], days)}):
        empty = df.sparkSession.createDataFrame([], schema)
        empty.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{partition_by[0]}={day}")


def _files_of_days(spark: SparkSession, path: str, column: str, days: Sequence[date | str]) -> set[tuple[date, str]]:
    table = table_or_none(spark, path) if days else None
    if table is None:
        return set()
    rows = table.where(F.col(column).isin([as_day(d) for d in days])).select(column, "_metadata.file_path").distinct()
    return {(row[0], row[1]) for row in rows.collect()}


def window_columns(install: date | str, window_days: int) -> dict[str, date | int]:
    """Columns that name a before / install / after dataset."""
    day = as_day(install)
    return {
        "before_date": day - timedelta(window_days),
        "install_date": day,
        "after_date": day + timedelta(window_days),
        "window_days": window_days,
    }


def overwrite_window(df: DataFrame, path: str, install: date | str, window_days: int, files: int | None = None) -> None:
    names = window_columns(install, window_days)
    stamped = df.withColumns({name: F.lit(value) for name, value in names.items()})
    overwrite_days(stamped, path, tuple(names), files)


def write_report_csv(df: DataFrame, path: str) -> None:
    """A report as one CSV file with a header; only its rows meet in one task. Reports are aggregates or short subscriber lists."""
    df.repartition(1).write.mode("overwrite").option("header", True).csv(path)


def write_table(df: DataFrame, path: str, options: Mapping[str, str] | None = None, fmt: str = "parquet") -> None:
    df.write.mode("overwrite").options(**(options or {})).format(fmt).save(path)
