"""Summary reports over the home-score table and the training rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from homescore.config import FEATURE_BINS, INCREMENT_EDGES, ImprovementRule, ModelFamilies
from homescore.functions.numeric import bin_index, bucket_label, percent
from homescore.operators.cohort import subscribers


def model_family(df: DataFrame, families: ModelFamilies, column: str = "dg_model_indiv") -> DataFrame:
    """Known router models only, the minor ones under one name."""
    model = F.col(column)
    return df.where(model.isin(*families.routers)).withColumn(
        column, F.when(model.isin(*families.other), F.lit(families.other_label)).otherwise(model)
    )


def month_model(homes: DataFrame, models: Sequence[str] | None = None) -> DataFrame:
    """Average home score and number of scores per month and model, in that order."""
    if models is not None:
        homes = homes.where(F.col("dg_model_indiv").isin(*models))
    months = homes.groupBy("dg_model_indiv", F.month(F.to_date("date")).alias("month")).agg(
        F.round(F.avg("home_score"), 2).alias("average_home_score"), F.count("home_score").alias("count")
    )
    return months.orderBy("month", "dg_model_indiv")


def day_model(homes: DataFrame, models: Sequence[str], in_list_order: bool = False) -> DataFrame:
    """Average home score and row count per model and day, ordered by model name or by the list."""
    rows = homes.withColumn("dg_model", F.explode(F.flatten("dg_model"))).dropDuplicates()
    days = (
        rows.where(F.col("dg_model").isin(*models))
        .groupBy("dg_model", "date")
        .agg(F.round(F.avg("home_score"), 2).alias("home_score"), F.count("*").alias("count"))
    )
    if in_list_order:
        listed = F.array(*[F.lit(m) for m in models])
        return days.orderBy(F.array_position(listed, F.col("dg_model")), "date")
    return days.orderBy("dg_model", "date")


def subscriber_history(homes: DataFrame, mdns: Sequence[str] | DataFrame) -> DataFrame:
    """Home-score history of a list of subscribers."""
    columns = ("serial_num", "home_score", "dg_model_indiv", "mdn", "cust_id", "date")
    return subscribers(homes, mdns).select(*columns)


def model_extract(homes: DataFrame, mdns: Sequence[str] | DataFrame, models: Sequence[str]) -> DataFrame:
    """Home rows of a list of subscribers and router models, one per element of the model set."""
    rows = homes.withColumn("dg_model_indiv", F.explode(F.flatten("dg_model")))
    listed = rows.where(F.col("dg_model_indiv").isin(*models))
    return subscribers(listed, mdns).drop("dg_model", "Rou_Ext")


def increment_distribution(
    df: DataFrame, edges: Sequence[float] = INCREMENT_EDGES, column: str = "score_increment"
) -> DataFrame:
    """Count and percentage of increments per bucket; increments outside all buckets are left out."""
    buckets = (
        df.select(bucket_label(F.col(column), edges).alias("range_label"))
        .dropna()
        .groupBy("range_label")
        .agg(F.count("*").alias("count"))
    )
    # At most one row per bucket reaches this window.
    total = F.sum("count").over(Window.partitionBy(F.lit(1)))
    return buckets.select(
        "range_label", "count", F.round(F.col("count") / total * 100, 2).alias("percentage_frequency")
    ).orderBy("range_label")


def feature_bins(df: DataFrame, bins: Mapping[str, Sequence[float]] = FEATURE_BINS) -> DataFrame:
    """Per feature and bin: number of homes and percentage whose score did not fall.

    All features are binned in one pass over the homes. Bins without homes are listed with count 0.
    """
    spark = df.sparkSession
    long = df.select(
        "score_increment",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("feature"), bin_index(F.col(name).cast("double"), edges).alias("bin")
                    )
                    for name, edges in bins.items()
                ]
            )
        ),
    ).where(F.col("bin").isNotNull())
    found = long.groupBy("feature", "bin").agg(
        F.count("*").alias("homes"),
        F.avg(F.when(F.col("score_increment") >= 0, 1.0).otherwise(0.0)).alias("positive"),
    )
    labels = [
        F.struct(F.lit(name).alias("feature"), F.lit(i).alias("bin"), F.lit(f"[{edges[i]}, {edges[i + 1]})").alias("bin_range"))
        for name, edges in bins.items()
        for i in range(len(edges) - 1)
    ]
    all_bins = spark.range(1).select(F.inline(F.array(*labels)))
    return all_bins.join(found, ["feature", "bin"], "left").select(
        "feature",
        "bin",
        "bin_range",
        F.round(F.col("positive") * 100, 4).alias("score_increment_pos"),
        F.coalesce("homes", F.lit(0).cast("bigint")).alias("count"),
    )


def predicted_improved(df: DataFrame, rule: ImprovementRule = ImprovementRule()) -> DataFrame:
    return df.where(selects(rule))


def selects(rule: ImprovementRule):
    return (
        (F.col("avg_phyrate") < rule.avg_phyrate_below)
        & (F.col("poor_phyrate") > rule.poor_phyrate_above)
        & (F.col("poor_rssi") > rule.poor_rssi_above)
        & (F.col("count") > rule.count_above)
    )


def rule_summary(df: DataFrame, rule: ImprovementRule = ImprovementRule()) -> DataFrame:
    """Homes, homes the rule selects, their share, and how many of them truly improved, in one row."""
    chosen = selects(rule)
    counts = df.agg(
        F.count("*").alias("homes"),
        F.count_if(chosen).alias("predicted"),
        F.count_if(chosen & (F.col("score_increment") > 0)).alias("improved"),
    )
    return counts.select(
        "homes",
        "predicted",
        F.round(percent(F.col("predicted"), F.col("homes")), 2).alias("predicted_pct"),
        F.round(percent(F.col("improved"), F.col("predicted")), 2).alias("improved_pct"),
    )


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts of equal-width bins on [low, high]; the last bin holds the upper edge, empty bins are listed."""
    value = F.col(column)
    inside = df.where(value.between(low, high)).select(
        F.least(F.width_bucket(value.cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins)), F.lit(bins))
        .cast("int")
        .alias("bin")
    )
    found = inside.groupBy("bin").agg(F.count("*").alias("n"))
    width = (high - low) / bins
    edges = df.sparkSession.range(1, bins + 1).select(
        F.col("id").cast("int").alias("bin"),
        (F.lit(float(low)) + (F.col("id") - 1) * width).alias("bin_low"),
        (F.lit(float(low)) + F.col("id") * width).alias("bin_high"),
    )
    return edges.join(found, "bin", "left").select(
        "bin", "bin_low", "bin_high", F.coalesce("n", F.lit(0).cast("bigint")).alias("count")
    )
