"""Exact medians of groups of any size, from value counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from homescore.sources.staging import stage

#: Distinct values of one group that are put in order at once; a larger group is narrowed down first.
ORDERED_AT_ONCE = 50_000
#: Ranges a group's values are counted in, and the exponent that stands below all others.
RANGES, _BELOW = 1024, 1100


def value_counts(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows of each group that hold a value: keys, name (of the column), value and n.

    Nulls are not counted. Counts of parts of a group add up to those of the whole.
    """
    named = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])
    each = df.select(*keys, F.inline(named)).where("value is not null")
    return each.groupBy(*keys, "name", "value").agg(F.count("*").alias("n"))


def medians(counts: DataFrame, keys: Sequence[str], at_once: int = ORDERED_AT_ONCE) -> DataFrame:
    """keys, name and median of each group of `counts` (keys, name, value, n; a value may come more than once).

    The median is the least value that at least half of the rows do not exceed. A group of few distinct
    values is put in order. A larger one is counted in ranges of values, first by powers of two, then in
    equal parts, until the range that holds the middle has few of them; only that range is ordered, so
    no task gets a group whole. `counts` is read once more for each round.
    """
    group = [*keys, "name"]
    merged = counts.groupBy(*group, "value").agg(F.sum("n").alias("n"))
    half = F.expr("(sum(n) + 1) div 2")
    sought = merged.groupBy(*group).agg(half.alias("rank"), F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("values"))
    sought = stage(sought, "medians")
    by_power = True
    while sought.where(F.col("values") > at_once).limit(1).count():
        large = merged.join(sought.where(F.col("values") > at_once), group).where("value between low and high")
        sought = stage(
            sought.where(F.col("values") <= at_once).unionByName(_middle_range(large, group, by_power)), "medians"
        )
        by_power = False
    inside = merged.join(sought.select(*group, "rank", "low", "high"), group).where("value between low and high")
    upto = F.sum("n").over(Window.partitionBy(*group).orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    ranked = inside.withColumn("upto", upto)
    return ranked.where("upto >= rank and upto - n < rank").select(*group, F.col("value").alias("median"))


def _middle_range(rows: DataFrame, group: Sequence[str], by_power: bool) -> DataFrame:
    """Of each group the range that holds its middle: the rank there, its ends and how many values it has."""
    value = F.col("value")
    if by_power:  # tells apart values of any size; the values of one range then differ by a factor of two at most
        power = F.floor(F.least(F.greatest(F.log2(F.abs(value)), F.lit(-float(_BELOW))), F.lit(float(_BELOW)))) + _BELOW + 1
        place = F.when(value == 0, 0).otherwise(F.signum(value) * power)
    else:
        part = (value - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(5e-324))
        place = F.least(F.floor(part * RANGES), F.lit(RANGES - 1))
    ranges = rows.groupBy(*group, place.cast("long").alias("place")).agg(
        F.sum("n").alias("n"), F.max("rank").alias("rank"), F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("values")
    )
    upto = F.sum("n").over(Window.partitionBy(*group).orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return (
        ranges.withColumn("upto", upto).where("upto >= rank and upto - n < rank")
        .select(*group, (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank"), "low", "high", "values")
    )


def with_medians(groups: DataFrame, found: DataFrame, keys: Sequence[str], columns: Sequence[str], prefix: str = "median_") -> DataFrame:
    """`groups` with one column of each median, null where a group has no value."""
    wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == c, F.col("median"))).alias(f"{prefix}{c}") for c in columns])
    return groups.join(wide, list(keys), "left")
