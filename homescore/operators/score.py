"""Device scores and home scores in the three published variants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homescore.config import (
    DEVICE_GROUP_KEYS,
    DEVICE_KEYS,
    DEVICE_PARENT_KEYS,
    HOME_KEYS,
    SCORE_A,
    SCORE_B,
    SCORE_C,
    TOPOLOGY_SETS,
    KpiRules,
    ScoreRules,
)
from homescore.operators import weights as W
from homescore.operators.kpi import device_kpis
from homescore.operators.reshape import round_columns
from homescore.operators.topology import attach_identity, attach_topology

ROLLUP_B = ("avg_phyrate", "poor_phyrate", "stationarity", "weights", "poor_rssi")
ROLLUP_C = (
    "avg_phyrate",
    "poor_phyrate",
    "stationarity",
    "volume",
    "weights",
    "poor_rssi",
    "avg_sig_strength_cat1",
    "avg_sig_strength_cat2",
    "avg_sig_strength_cat3",
)


def score_expr(rules: ScoreRules) -> Column:
    return (100 - F.col("poor_rssi")) * rules.rssi_share + (100 - F.col("poor_phyrate")) * rules.phy_share


def device_rollup(df: DataFrame, keys: Sequence[str] = DEVICE_KEYS) -> DataFrame:
    """One row per device: the sets of routers and extenders it used.

    Rows move by device before their sets are built, as most are in no other set yet: six sets of one
    member each are longer than the row.
    """
    return df.repartition(*keys).groupBy(*keys).agg(*[F.sort_array(F.collect_set(name)).alias(name) for name in TOPOLOGY_SETS])


def _located(weighted: DataFrame, identified: DataFrame, groups: DataFrame, features: Sequence[str]) -> DataFrame:
    """Topology per parent, rolled up per device and joined to the device's row with its subscribers.

    Only keys and parents meet the topology, so a device's figures are neither copied nor averaged back.
    Subscribers are found before the sets are joined, so the long rows stay where the sets were built.
    """
    per_parent = weighted.select(*DEVICE_KEYS, F.inline("parents"))
    found = device_rollup(attach_topology(per_parent, groups))
    devices = identified.select(*DEVICE_GROUP_KEYS, *features)
    return devices.join(found, list(DEVICE_KEYS)).select(*DEVICE_GROUP_KEYS, *features, *TOPOLOGY_SETS)


def kpis_a(telemetry: DataFrame, kpi_rules: KpiRules = KpiRules()) -> DataFrame:
    """What variant A needs of each device and parent."""
    used = ("n_rssi", "n_phy", "avg_phyrate", "poor_phyrate", "poor_rssi")
    return device_kpis(telemetry, kpi_rules, DEVICE_PARENT_KEYS).select(*DEVICE_PARENT_KEYS, *used)


def device_scores_a(
    kpis: DataFrame,
    groups: DataFrame,
    identity: DataFrame,
    rules: ScoreRules = SCORE_A,
    kpi_rules: KpiRules = KpiRules(),
    per_home: bool = False,
) -> DataFrame:
    """Variant A: scores per device and parent of `kpis_a`, for homes with a known subscriber.

    All variants read `kpis` for totals and for rows, so a job writes that small table first.
    """
    weighted = (
        W.weights_a(kpis, rules, per_home)
        .dropna(subset=list(DEVICE_PARENT_KEYS))
        .where(F.col("n_rssi") >= kpi_rules.min_readings)
        .select(*DEVICE_PARENT_KEYS, "avg_phyrate", "poor_phyrate", "weights", "poor_rssi")
    )
    # Identity comes last: behind a filter on extenders only those rows move to their subscriber.
    located = attach_identity(attach_topology(weighted, groups), identity, "inner")
    figures = [c for c in weighted.columns if c != "serial_num"]
    place = ("RouExt_mac", "dg_model", "parent_mac", "firmware", "Rou_Ext")
    return located.select("serial_num", *figures, "mdn", "cust_id", *place).withColumn("device_score", score_expr(rules))


def home_scores_a(devices: DataFrame) -> DataFrame:
    """Weighted scores per home, extender and router devices apart."""
    return devices.groupBy(*HOME_KEYS, "Rou_Ext").agg(
        *_weighted_sums(places=None), F.max("firmware").alias("firmware")
    )


def extender_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col("Rou_Ext") == 1)


def kpis_b(telemetry: DataFrame, kpi_rules: KpiRules = KpiRules()) -> DataFrame:
    """What variant B needs of each device: no volumes, no signal by band."""
    used = ("n_rssi", "n_phy", "avg_phyrate", "poor_phyrate", "stationarity", "kept", "poor_rssi", "parents")
    return device_kpis(telemetry, kpi_rules).select(*DEVICE_KEYS, *used)


def device_scores_b(
    kpis: DataFrame,
    groups: DataFrame,
    identity: DataFrame,
    rules: ScoreRules = SCORE_B,
    kpi_rules: KpiRules = KpiRules(),
) -> DataFrame:
    """Variant B: weights cut for slow stationary devices, two roundings."""
    weighted = W.weights_b(kpis, rules, kpi_rules)
    return _located(weighted, attach_identity(weighted, identity), groups, ROLLUP_B).withColumn("device_score", score_expr(rules))


def located_devices_c(
    kpis: DataFrame,
    groups: DataFrame,
    identity: DataFrame,
    rules: ScoreRules = SCORE_C,
    kpi_rules: KpiRules = KpiRules(),
) -> DataFrame:
    """Devices of variant C with their place and subscriber, weighted from traffic volume.

    Weights sum to 1 per subscriber of a home. The first share divides every device of a home by the
    same total, which the second share cancels, so the second is taken straight from the volumes: over
    devices with a parent, as others have no place, and before the sets are joined, so long rows do not
    move. The telemetry must hold complete readings only.
    """
    scored = kpis.dropna(subset=list(DEVICE_KEYS)).where((F.col("n_rssi") >= kpi_rules.min_readings) & (F.col("n_phy") > 0) & F.col("kept"))
    weighted = scored.withColumn("weights", F.col("volume")).transform(W.penalise_slow, rules)
    placed = weighted.where(F.size("parents") > 0)
    return _located(placed, W.renormalise(attach_identity(placed, identity)), groups, ROLLUP_C)


def device_scores_c(located: DataFrame, rules: ScoreRules = SCORE_C) -> DataFrame:
    """Variant C: scores of `located_devices_c`."""
    return located.withColumn("device_score", score_expr(rules)).select(
        *DEVICE_GROUP_KEYS, *ROLLUP_C, *TOPOLOGY_SETS, "device_score"
    )


def rounded_device_scores(devices: DataFrame) -> DataFrame:
    """The device table as stored: KPIs to 2 places, weights to 4, no repeated rows."""
    names = ("avg_phyrate", "poor_phyrate", "poor_rssi", "device_score", "volume")
    stored = round_columns(devices, 2, [n for n in names if n in devices.columns])
    return round_columns(stored, 4, ["weights"]).dropDuplicates()


def _weighted_sums(places: int | None = 4, score: str = "device_score") -> list[Column]:
    """Sums of products kept to 14 places: exact in any order, so a tie always rounds the same way."""

    def total(name: str) -> Column:
        value = F.sum((F.col(name) * F.col("weights")).cast("decimal(28,14)"))
        return (value if places is None else F.round(value, places)).cast("double")

    return [
        total("poor_rssi").alias("poor_rssi"),
        total("poor_phyrate").alias("poor_phyrate"),
        total(score).alias("home_score"),
    ]


def home_scores(devices: DataFrame) -> DataFrame:
    """Weighted scores per home, one row per model found in the home.

    Homes without any known model have no row.
    """
    homes = devices.groupBy(*HOME_KEYS).agg(
        F.count("*").alias("num_station"),
        *_weighted_sums(),
        F.collect_set("dg_model").alias("dg_model"),
        F.collect_set("Rou_Ext").alias("Rou_Ext"),
    )
    return homes.withColumn("dg_model_indiv", F.explode(F.array_distinct(F.flatten("dg_model"))))


def rescore_homes(devices: DataFrame) -> DataFrame:
    """Home scores from stored device rows, after folding rows that differ only in their sets."""
    once = devices.groupBy(
        *HOME_KEYS, "station_mac", "poor_rssi", "poor_phyrate", "weights", "device_score"
    ).agg(
        F.sort_array(F.collect_set("dg_model")).alias("dg_model"),
        F.sort_array(F.collect_set("Rou_Ext")).alias("Rou_Ext"),
    )
    homes = once.groupBy(*HOME_KEYS).agg(
        *_weighted_sums(),
        F.collect_set("dg_model").alias("dg_model"),
        F.collect_set("Rou_Ext").alias("Rou_Ext"),
    )
    models = F.array_distinct(F.flatten(F.flatten("dg_model")))
    return homes.withColumn("dg_model_indiv", F.explode(models))


def homes_from_detail(detail: DataFrame, identity: DataFrame) -> DataFrame:
    """Home scores from legacy detail rows, with the identity taken from a mapping instead."""
    homes = detail.groupBy(*HOME_KEYS).agg(
        *_weighted_sums(score="score"),
        F.max("dg_model").alias("dg_model"),
        F.max("date").alias("date"),
    )
    per_model = homes.drop("mdn", "cust_id").withColumn(
        "dg_model_indiv", F.explode(F.array_distinct("dg_model"))
    )
    return attach_identity(per_model, identity).dropDuplicates()
