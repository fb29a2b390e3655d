"""Readers for the input formats."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from homescore.sources.days import day_list, existing_paths, path_of, under


_LINE = "__line"


def read_parquet(spark: SparkSession, path: str, schema: StructType | None = None, recursive: bool = False) -> DataFrame:
    return _reader(spark, schema, recursive).parquet(path)


def read_json(spark: SparkSession, path: str, schema: StructType | None = None, recursive: bool = False) -> DataFrame:
    """With a schema the files are read once; without one Spark reads them first to infer it."""
    return _reader(spark, schema, recursive).json(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None, recursive: bool = False) -> DataFrame:
    """CSV with a header line; all columns are strings unless a schema is given."""
    return _reader(spark, schema, recursive).option("header", True).csv(path)


def _reader(spark: SparkSession, schema: StructType | None, recursive: bool):
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.option("recursiveFileLookup", True) if recursive else reader


def read_marked(
    spark: SparkSession,
    path: str,
    schema: StructType,
    fmt: str = "json",
    required: Sequence[str] = (),
    checks: Mapping[str, Column] | None = None,
    recursive: bool = False,
    header: bool = True,
) -> DataFrame:
    """Rows of JSON or CSV files with `reason`: why a row cannot be used, null for good rows; and `line`.

    The first reason that holds is given: "malformed" for a line that does not parse under `schema`, or
    has a value of another type or another number of fields; "no <column>" for a required column without
    a value; then the names of `checks` whose condition holds. `line` is the text of a malformed line.
    Nothing is dropped and no line stops the read.
    """
    whole = StructType([*schema.fields, StructField(_LINE, StringType())])
    # whole lines are parsed, whatever columns a query needs: reasons must not depend on the query
    reader = _reader(spark, whole, recursive).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _LINE).option("columnPruning", False)
    rows = reader.format(fmt).option("header", header).load(path)
    arms = [(F.col(_LINE).isNotNull(), "malformed"), *[(F.col(c).isNull(), f"no {c}") for c in required]]
    arms += [(F.coalesce(condition, F.lit(False)), name) for name, condition in (checks or {}).items()]
    reason = F.coalesce(*[F.when(condition, F.lit(name)) for condition, name in arms])
    return rows.withColumn("reason", reason).withColumnRenamed(_LINE, "line")


def set_aside(marked: DataFrame, path: str) -> DataFrame:
    """Store the bad rows of `read_marked` under `path`, by reason, and return the good ones."""
    marked.where("reason is not null").write.mode("overwrite").partitionBy("reason").parquet(path)
    return marked.where("reason is null").drop("reason", "line")


def reason_counts(marked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows for each reason ("good" where there is none), and for each value of `by`."""
    return marked.groupBy(*by, F.coalesce("reason", F.lit("good")).alias("reason")).agg(F.count("*").alias("count"))


def read_day_folders(
    spark: SparkSession,
    pattern: str,
    start: date | str,
    count: int,
    fmt: str = "parquet",
    schema: StructType | None = None,
    on_missing: str = "skip",
    column: str = "date",
    day_format: str = "%Y-%m-%d",
) -> DataFrame:
    """Days kept as one folder or file each ('.../{}' or '.../{}/name'), read in a single scan.

    Adds the day as `column`, taken from the place of '{}' in the file's whole path. Missing days are skipped or raise.
    """
    wanted = {pattern.format(d.strftime(day_format)): d for d in day_list(start, count)}
    found = existing_paths(spark, pattern, [d.strftime(day_format) for d in wanted.values()])
    if on_missing == "error" and len(found) < len(wanted):
        raise FileNotFoundError("no data at " + ", ".join(sorted(set(wanted) - set(found))))
    if not found:
        raise FileNotFoundError(f"no data for any day of {pattern}")
    reader = _reader(spark, schema, recursive=True).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    rows = reader.load(found)
    source = path_of(F.col("_metadata.file_path"))
    day = F.coalesce(*[F.when(under(source, path), F.lit(wanted[path])) for path in found])
    return rows.withColumn(column, day)


def jdbc_options(
    url: str,
    query: str,
    driver: str | None = None,
    user: str | None = None,
    password: str | None = None,
    query_timeout: int = 3600,
    fetch_size: int = 10000,
    partition: tuple[str, str, str, int] | None = None,
) -> dict[str, str]:
    """Options of a JDBC query; `partition` = (column, lower, upper, parts) splits it over tasks."""
    options = {"url": url, "queryTimeout": str(query_timeout), "fetchsize": str(fetch_size)}
    if partition is None:
        options["query"] = query
    else:
        column, lower, upper, parts = partition
        # A partitioned read needs a table expression; a bare query cannot be split.
        options["dbtable"] = f"({query}) q"
        options.update(partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=str(parts))
    for name, value in (("driver", driver), ("user", user), ("password", password)):
        if value is not None:
            options[name] = value
    return options


def read_jdbc(spark: SparkSession, url: str, query: str, **options) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(url, query, **options)).load()


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames, matched by column name, repeated rows kept."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame)
    return first
