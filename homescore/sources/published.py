"""Days whose tables become visible together: rows are written aside, then one manifest row names them.

A store is a folder with a folder for every table, partitioned by `date` and `version`, and the manifest. A
version that no manifest row names is never read, so a job that fails between two tables of a day leaves
readers with the old day whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import date
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from homescore.sources.days import as_day, in_days, table_or_none

_MANIFEST = "manifest"
_SCHEMA = "date date, seq long, version string, tables array<string>"


def _manifest(spark: SparkSession, store: str) -> DataFrame:
    rows = table_or_none(spark, f"{store}/{_MANIFEST}")
    return spark.createDataFrame([], _SCHEMA) if rows is None else rows.select("date", "seq", "version", "tables")


def newest(spark: SparkSession, store: str, table: str | None = None) -> DataFrame:
    """date, seq and version of the newest published version of each day (that has `table`)."""
    rows = _manifest(spark, store)
    latest = rows.groupBy("date").agg(F.max(F.struct("seq", "version", "tables")).alias("last")).select("date", "last.*")
    return (latest if table is None else latest.where(F.array_contains("tables", table))).drop("tables")


class Draft:
    """The tables of one day, written aside until `publish` makes them visible together."""

    def __init__(self, spark: SparkSession, store: str, day: date | str) -> None:
        self.spark, self.store, self.day = spark, store.rstrip("/"), as_day(day)
        self.version, self.tables = uuid.uuid4().hex, []

    def write(self, table: str, rows: DataFrame, files: int | None = None) -> DataFrame:
        """Write the day's rows of `table` and return them as they are stored, without date and version."""
        sized = rows.drop("date").hint("rebalance") if files is None else rows.drop("date").repartition(files)
        path = f"{self.store}/{table}/date={self.day}/version={self.version}"
        sized.write.parquet(path)
        self.tables.append(table)
        return self.spark.read.schema(rows.drop("date").schema).parquet(path)

    def publish(self) -> None:
        """Name this version in the manifest: one row in one file, so it is there whole or not at all."""
        last = _manifest(self.spark, self.store).where(F.col("date") == F.lit(self.day)).agg(F.max("seq")).first()[0]
        row = [(self.day, (last or 0) + 1, self.version, self.tables)]
        self.spark.createDataFrame(row, _SCHEMA).repartition(1).write.mode("append").parquet(f"{self.store}/{_MANIFEST}")


def read_published(spark: SparkSession, store: str, table: str, first: date | str | None = None, count: int | None = None) -> DataFrame:
    """Rows of the newest version of every day (of `count` days from `first` on), with their date.

    The versions, one a day, are put into the partition filter, so other versions and days are not scanned.
    """
    days = newest(spark, store.rstrip("/"), table)
    if first is not None:
        days = days.where(in_days(first, count))
    chosen = days.collect()
    if not chosen:
        raise FileNotFoundError(f"no published day of {table} in {store}")
    rows = spark.read.option("basePath", f"{store.rstrip('/')}/{table}").parquet(*[f"{store.rstrip('/')}/{table}/date={r['date']}/version={r['version']}" for r in chosen])
    named = reduce(or_, [(F.col("date") == F.lit(r["date"])) & (F.col("version") == F.lit(r["version"])) for r in chosen])
    return rows.where(named).drop("version")


def open_days(spark: SparkSession, store: str, days: Sequence[date]) -> list[date]:
    """Of `days` those that have no published version, latest first."""
    done = {r["date"] for r in newest(spark, store.rstrip("/")).where(F.col("date").isin([F.lit(d) for d in days])).select("date").collect()} if days else set()
    return sorted(set(days) - done, reverse=True)
