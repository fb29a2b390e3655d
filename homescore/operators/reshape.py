"""Schema-driven reshaping: flatten structs, explode arrays, cast and round many columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATOR = "_b_"


def _quoted(*path: str) -> str:
    return ".".join(f"`{part}`" for part in path)


def flatten_structs(df: DataFrame, sep: str = SEPARATOR) -> DataFrame:
    """All struct leaves as columns named parent + sep + child, in one projection.

    Columns that are already flat come first; each level of nesting follows the one above it.
    """
    leaves = [((f.name,), f.name, f.dataType) for f in df.schema.fields]
    while any(isinstance(dtype, T.StructType) for _, _, dtype in leaves):
        flat = [leaf for leaf in leaves if not isinstance(leaf[2], T.StructType)]
        opened = [
            (path + (child.name,), name + sep + child.name, child.dataType)
            for path, name, dtype in leaves
            if isinstance(dtype, T.StructType)
            for child in dtype.fields
        ]
        leaves = flat + opened
    return df.select([F.col(_quoted(*path)).alias(name) for path, name, _ in leaves])


def flatten_all(df: DataFrame, sep: str = SEPARATOR) -> DataFrame:
    """Flatten structs and explode arrays until neither is left.

    Several arrays in a row give all combinations; a NULL or empty array drops the row.
    """
    flat = flatten_structs(df, sep)
    arrays = [f.name for f in flat.schema.fields if isinstance(f.dataType, T.ArrayType)]
    if not arrays:
        return flat
    return flatten_all(explode_column(flat, arrays[-1]), sep)


def explode_column(df: DataFrame, column: str, out: str | None = None, depth: int = 1) -> DataFrame:
    """One row per element of an array column, `depth` levels deep."""
    values = F.col(_quoted(column))
    for _ in range(depth - 1):
        values = F.flatten(F.filter(values, lambda inner: inner.isNotNull()))
    return df.withColumn(out or column, F.explode(values))


def rename_and_cast(df: DataFrame, mapping: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Add a column per entry of {source: (type, new name)}; values that do not fit are NULL."""
    from homescore.functions.parsing import lenient_long

    # All sources in one selection, so the frame is analysed once.
    types = dict(zip(mapping, (f.dataType for f in df.select(*mapping).schema)))

    def converted(source: str, dtype: str) -> Column:
        value = F.col(source)
        if dtype in ("long", "bigint") and isinstance(types[source], T.StringType):
            return lenient_long(value)
        return value.try_cast(dtype)

    return df.withColumns({name: converted(source, dtype) for source, (dtype, name) in mapping.items()})


def cast_all_but(df: DataFrame, keep: Iterable[str], dtype: str = "double") -> DataFrame:
    """Every column cast to `dtype` except those in `keep`."""
    keep = set(keep)
    return df.select(
        [
            F.col(_quoted(name)) if name in keep else F.col(_quoted(name)).try_cast(dtype).alias(name)
            for name in df.columns
        ]
    )


def round_columns(df: DataFrame, places: int = 4, columns: Iterable[str] | None = None) -> DataFrame:
    """Round the given columns, or all float and double columns."""
    if columns is None:
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({name: F.round(F.col(_quoted(name)), places) for name in columns})


def stamp_date(df: DataFrame, day: str, column: str = "date") -> DataFrame:
    return df.withColumn(column, F.lit(day).cast("date"))
