"""Tables stored in buckets of homes: grouping and joining by home needs no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def write_bucketed(df: DataFrame, name: str, path: str, buckets: int, by: Sequence[str] = ("serial_num",), partition_by: Sequence[str] = ()) -> DataFrame:
    """Store `df` at `path` as table `name`, in `buckets` buckets of `by`, and return the table.

    Each partition has a file for every bucket, so the number of buckets is that of tasks which later
    read a window together; rows are shuffled once, here. Tables that are joined have the same number.
    """
    dealt = df.repartition(buckets, *by)
    writer = dealt.write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, *by).sortBy(*by)
    (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def open_bucketed(spark: SparkSession, name: str, path: str, schema: StructType, buckets: int, by: Sequence[str] = ("serial_num",), partition_by: Sequence[str] = ()) -> DataFrame:
    """A table that `write_bucketed` stored, named anew in a session that does not know it."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    listed = lambda names: ", ".join(f"`{n}`" for n in names)
    parts = f"PARTITIONED BY ({listed(partition_by)})" if partition_by else ""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet {parts}"
        f" CLUSTERED BY ({listed(by)}) SORTED BY ({listed(by)}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    if partition_by:
        spark.catalog.recoverPartitions(name)
    return spark.table(name)
