"""One query per operator, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from homescore import adapter as A
from homescore.config import (
    DEVICE_KEYS,
    SWEEP_FEATURES,
    ImprovementRule,
    KpiRules,
    ModelFamilies,
    RecommendationRules,
)
from homescore.functions import parsing
from homescore.operators import cohort, dataset, features, kpi, medians, model, presence, report, reshape, score, states, topology, trees
from homescore.operators import telemetry as telemetry_ops
from homescore.operators import weights as W
from homescore.schemas import GROUP_ROOT
from homescore.sources import bucketed, days, files, published, sinks, staging

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the queries; the SQL twins use the same values.
WINDOW_START, AFTER_START, WINDOW_DAYS = "2024-01-01", "2024-01-15", 7
COHORT_INSTALL, COHORT_DAYS = "2024-01-10", 3
COUNT_START, COUNT_BEFORE, COUNT_AFTER = "2024-01-07", 2, 3
POPULATION_DAY = "2024-01-22"
MODELS = ("click", "purchase", "view")
FAMILIES = ModelFamilies(main=("click", "error", "view"), other=("signup",))
PRIORITIES = ("1-URGENT", "2-HIGH", "5-LOW")
MDNS = ("D1", "D7", "D33")
RULE = ImprovementRule(avg_phyrate_below=400, poor_phyrate_above=6, poor_rssi_above=20, count_above=10)


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to 4 places, dates as text and arrays as sorted, joined text, so results can be compared."""
    columns = []
    for field in df.schema.fields:
        value, dtype = F.col(f"`{field.name}`"), field.dataType
        if isinstance(dtype, T.DoubleType):
            value = F.round(value, 4)
        elif isinstance(dtype, T.DateType):
            value = value.cast("string")
        elif isinstance(dtype, T.ArrayType):
            while isinstance(dtype.elementType, T.ArrayType):
                value, dtype = F.flatten(value), dtype.elementType
            texts = F.sort_array(F.array_distinct(value.cast("array<string>")))
            value = F.array_join(texts, ",")
        columns.append(value.alias(field.name))
    return df.select(columns)


# --- inputs shared by several queries -------------------------------------------------------------


def _groups(spark: SparkSession, sf: str) -> DataFrame:
    return topology.device_groups(A.group_records(spark, sf))


def _identity(spark: SparkSession, sf: str, **options) -> DataFrame:
    return topology.subscriber_identity(A.subscriber_map(spark, sf), **options)


def _parsed(spark: SparkSession, sf: str, complete: bool) -> DataFrame:
    return telemetry_ops.telemetry(A.station_history(spark, sf, A.SCORED_FIELDS), complete=complete)


def _kpis(spark: SparkSession, sf: str, **options) -> DataFrame:
    return kpi.device_kpis(A.telemetry(spark, sf), **options)


def _device_days(spark: SparkSession, sf: str, start: str, count: int = WINDOW_DAYS) -> DataFrame:
    return days.window_of_days(A.device_days(spark, sf), start, count)


def _home_days(spark: SparkSession, sf: str, start: str, count: int = WINDOW_DAYS) -> DataFrame:
    return days.window_of_days(A.home_days(spark, sf), start, count)


def _training(spark: SparkSession, sf: str, count: int = WINDOW_DAYS, after: str = AFTER_START) -> DataFrame:
    """Before / after rows of all homes, with the increment."""
    rows = dataset.before_after_set(
        A.device_days(spark, sf), A.home_days(spark, sf), None, WINDOW_START, after, count
    )
    return dataset.with_increment(rows)


def _count_cohort(spark: SparkSession, sf: str) -> DataFrame:
    return cohort.cohort_by_counts(
        A.home_days(spark, sf),
        COUNT_START,
        COUNT_BEFORE,
        COUNT_AFTER,
        before=lambda rows: rows <= 2,
        after=lambda rows: rows >= 2,
    )


# --- reshape and parsing --------------------------------------------------------------------------


def telemetry_parse(spark, sf):
    return tidy(_parsed(spark, sf, complete=False))


def telemetry_complete(spark, sf):
    return tidy(_parsed(spark, sf, complete=True))


def flatten_struct(spark, sf):
    return tidy(reshape.flatten_structs(A.station_history(spark, sf)))


def flatten_arrays(spark, sf):
    orders = A.table(spark, sf, "orders")
    marks = F.when(
        F.col("o_orderstatus") != "P", F.array("o_orderstatus", "o_orderpriority")
    ).otherwise(F.array().cast("array<string>"))
    amounts = F.array(
        F.struct(F.lit("total").alias("kind"), F.col("o_totalprice").alias("amount")),
        F.struct(F.lit("half").alias("kind"), (F.col("o_totalprice") / 2).alias("amount")),
    )
    nested = orders.select(
        F.struct(F.struct(F.col("o_orderkey").alias("key")).alias("id"), marks.alias("marks")).alias("head"),
        amounts.alias("amounts"),
    )
    return tidy(reshape.flatten_all(nested))


def explode_groups(spark, sf):
    return tidy(_groups(spark, sf))


def explode_nested(spark, sf):
    homes = A.home_days(spark, sf).select("date", "serial_num", "dg_model_indiv", "dg_model")
    return tidy(reshape.explode_column(homes, "dg_model", depth=2))


def row_keys(spark, sf):
    key = F.col("rowkey")
    return (
        A.telemetry(spark, sf)
        .select("rowkey")
        .distinct()
        .select(
            "rowkey",
            parsing.row_prefix(key).alias("rk_row"),
            parsing.serial_number(key).alias("serial_num"),
            parsing.short_serial(key).alias("rk_sn"),
            F.length(key).alias("rowkey_length"),
            F.length(parsing.short_serial(key)).alias("rk_sn_length"),
            parsing.group_key(key).alias("rk_row_sn"),
        )
    )


def cast_rename_map(spark, sf):
    readings = telemetry_ops.metric_telemetry(A.station_history(spark, sf))
    return tidy(readings.withColumn("time", F.date_format("time", "yyyy-MM-dd HH:mm:ss")))


def cast_all_but(spark, sf):
    return tidy(reshape.cast_all_but(A.table(spark, sf, "part"), keep=["p_name", "p_type"]))


def round_columns(spark, sf):
    lines = A.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_returnflag",
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
    )
    return reshape.round_columns(lines, 2)


def epoch_ms_to_ts(spark, sf):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    moment = parsing.epoch_ms(ms)
    return A.table(spark, sf, "events").select(
        "event_id", F.date_format(moment, "yyyy-MM-dd HH:mm:ss").alias("time")
    )


# --- device KPIs and weights ----------------------------------------------------------------------


def poor_rssi(spark, sf):
    return tidy(kpi.poor_rssi(_kpis(spark, sf)))


def poor_phyrate(spark, sf):
    return tidy(kpi.poor_phyrate(_kpis(spark, sf)))


def stationarity(spark, sf):
    return tidy(kpi.stationarity(_kpis(spark, sf)))


def stationarity_lenient(spark, sf):
    return tidy(kpi.stationarity(_kpis(spark, sf, rules=KpiRules(strict=False))))


def stationarity_exact(spark, sf):
    rows = kpi.stationarity_rows(A.telemetry(spark, sf))
    return tidy(rows.select(*DEVICE_KEYS, "parent_id", "sdcd_signal_strength", "stationarity"))


def _weights(df: DataFrame) -> DataFrame:
    return tidy(df.select(*DEVICE_KEYS, "avg_phyrate", "poor_phyrate", "weights"))


def _staged_kpis(spark: SparkSession, sf: str) -> DataFrame:
    """Written once, since every weighting reads the per-device table for totals and for rows."""
    return staging.stage(_kpis(spark, sf).drop("parents"), "device-kpis")


def weights_a(spark, sf):
    return _weights(W.weights_a(_staged_kpis(spark, sf)))


def weights_a_per_home(spark, sf):
    return _weights(W.weights_a(_staged_kpis(spark, sf), per_home=True))


def weights_b(spark, sf):
    return _weights(W.weights_b(_staged_kpis(spark, sf)))


def weights_c(spark, sf):
    return _weights(W.weights_c(_staged_kpis(spark, sf)))


def volume_share(spark, sf):
    shared = W.volume_share(_staged_kpis(spark, sf))
    return tidy(shared.select(*DEVICE_KEYS, "byte_send", "byte_received", "volume", "weights"))


# --- identity, topology, scores -------------------------------------------------------------------


def _device_list(spark: SparkSession, sf: str) -> DataFrame:
    return A.telemetry(spark, sf).select(*DEVICE_KEYS).distinct()


def identity_join(spark, sf):
    return topology.attach_identity(_device_list(spark, sf), _identity(spark, sf))


def identity_inner(spark, sf):
    return topology.attach_identity(_device_list(spark, sf), _identity(spark, sf, status=None), "inner")


def identity_left(spark, sf):
    known = _identity(spark, sf, status=None)
    return topology.attach_identity(_device_list(spark, sf), known).dropDuplicates()


def topology_join(spark, sf):
    pairs = A.telemetry(spark, sf).select(*DEVICE_KEYS, "parent_id").distinct()
    return tidy(topology.attach_topology(pairs, _groups(spark, sf)))


def _scores_a(spark: SparkSession, sf: str) -> DataFrame:
    identity = _identity(spark, sf, status=None, distinct=False)
    # Single parents rarely give enough readings here; the minimum is the only rule that differs.
    rules = KpiRules(min_readings=1)
    kpis = staging.stage(score.kpis_a(_parsed(spark, sf, False), rules), "device-kpis")
    return score.device_scores_a(kpis, _groups(spark, sf), identity, kpi_rules=rules)


def device_score_a_published(spark, sf):
    """Variant A by its own minimum of readings, on readings gathered under two parents."""
    part = F.substring("parent_id", 2, 20).cast("long")
    parent = F.when(part % 5 == 0, "P2").otherwise("P1")
    kpis = staging.stage(score.kpis_a(_parsed(spark, sf, False).withColumn("parent_id", parent)), "device-kpis")
    identity = _identity(spark, sf, status=None, distinct=False)
    return tidy(score.device_scores_a(kpis, _groups(spark, sf), identity))


def _scores_b(spark: SparkSession, sf: str) -> DataFrame:
    kpis = staging.stage(score.kpis_b(_parsed(spark, sf, False)), "device-kpis")
    return score.device_scores_b(kpis, _groups(spark, sf), _identity(spark, sf))


def _scores_c(spark: SparkSession, sf: str) -> DataFrame:
    # parents and figures are two readings of the device table, so it is written once
    kpis = staging.stage(kpi.device_kpis(_parsed(spark, sf, True)), "device-kpis")
    return score.device_scores_c(score.located_devices_c(kpis, _groups(spark, sf), _identity(spark, sf)))


def device_score_a(spark, sf):
    return tidy(score.extender_rows(_scores_a(spark, sf)))


def device_score_b(spark, sf):
    return tidy(score.rounded_device_scores(_scores_b(spark, sf)))


def device_score_c(spark, sf):
    return tidy(score.rounded_device_scores(_scores_c(spark, sf)))


def home_score_a(spark, sf):
    return tidy(score.extender_rows(score.home_scores_a(_scores_a(spark, sf))))


def home_score_b(spark, sf):
    return tidy(score.home_scores(_scores_b(spark, sf)))


def home_score_c(spark, sf):
    return tidy(score.home_scores(_scores_c(spark, sf)))


def rescore_homes(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    stored = A.table(spark, sf, "events").select(
        F.concat(F.lit("H"), F.col("user_id").cast("string")).alias("serial_num"),
        F.lit(None).cast("string").alias("mdn"),
        (F.col("user_id") % 9).cast("string").alias("cust_id"),
        F.concat(F.lit("M"), (k % 10).cast("string")).alias("station_mac"),
        k.cast("double").alias("poor_rssi"),
        (k / 2).alias("poor_phyrate"),
        (k / 100).alias("weights"),
        (100 - k).cast("double").alias("device_score"),
        F.array("event_type").alias("dg_model"),
        F.array((F.col("event_type") == "purchase").cast("int")).alias("Rou_Ext"),
    )
    return tidy(score.rescore_homes(stored))


def home_from_detail(spark, sf):
    lines = A.table(spark, sf, "lineitem")
    detail = lines.select(
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"),
        A.serial(F.col("l_suppkey")).alias("serial_num"),
        F.concat(F.lit("D"), F.col("l_linenumber").cast("string")).alias("mdn"),
        F.col("l_linestatus").alias("cust_id"),
        (F.col("l_discount") * 100).alias("poor_rssi"),
        (F.col("l_tax") * 100).alias("poor_phyrate"),
        F.col("l_quantity").alias("score"),
        (F.col("l_extendedprice") / 100000).alias("weights"),
        F.array("l_returnflag", "l_linestatus", "l_returnflag").alias("dg_model"),
    )
    return tidy(score.homes_from_detail(detail, _identity(spark, sf, status=None)))


# --- days -----------------------------------------------------------------------------------------


def _event_days(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "events").select(
        "event_id", "user_id", "event_type", F.to_date("ts").alias("date")
    )


def latest_snapshot(spark, sf):
    return tidy(days.latest_snapshot(_event_days(spark, sf), "2024-02-02", 5, 1))


def snapshot_fallback(spark, sf):
    return tidy(days.snapshot_or_fallback(_event_days(spark, sf), "2024-02-15", "2024-01-05"))


def _snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Subscriber maps of some days: a home that was seen on such a day has a number that names the day."""
    seen = A.device_days(spark, sf).where(F.dayofmonth("date").isin(2, 3, 6, 11, 14)).select("date", "serial_num", "cust_id").distinct()
    return seen.select(
        "date", F.col("serial_num").alias("serialnumber"), F.concat_ws("@", "serial_num", F.col("date").cast("string")).alias("mdn_5g"), "cust_id",
        F.when(F.substring("serial_num", 2, 9).cast("int") % 5 > 0, topology.INSTALLED).otherwise("PENDING").alias("status"),
    )


def snapshots_as_of(spark, sf):
    """The newest snapshot, one to four days old, of each of nine days, from one scan."""
    rows = days.as_of(_snapshots(spark, sf), days.day_list("2024-01-05", 9), 4, 1)
    return tidy(rows.groupBy("as_of", "date").agg(F.count("*").alias("homes")))


def identity_as_of(spark, sf):
    """Homes of nine days with the subscriber that each day's own newest snapshot names."""
    wanted = days.day_list("2024-01-05", 9)
    homes = days.window_of_days(A.home_days(spark, sf), wanted[0], 9).select("date", "serial_num", "dg_model_indiv")
    return tidy(topology.attach_identity_as_of(homes, days.as_of(_snapshots(spark, sf), wanted, 4, 1)))


def topology_as_of(spark, sf):
    """Device parents of nine days, each placed by the group records of its own day's newest snapshot."""
    wanted, kind = days.day_list("2024-01-05", 9), F.col("event_type")
    events = _event_days(spark, sf)
    rows = events.select("date", F.concat(F.lit("H"), F.col("user_id").cast("string")).alias("rk_row_sn"), kind.alias("parent_id")).distinct()
    member = F.struct(
        kind.alias("mac"), F.concat(F.lit("m"), F.dayofmonth("date").cast("string")).alias("model"),
        F.when(F.col("event_id") % 2 == 0, F.lit("G")).alias("parent_mac"), F.concat(F.lit("fw"), (F.col("event_id") % 9).cast("string")).alias("fw"),
    )
    groups = events.where(F.dayofmonth("date").isin(2, 3, 6, 11, 14)).select("date", F.concat(F.lit("H"), F.col("user_id").cast("string")).alias("rowkey"), F.array(member).alias(GROUP_ROOT))
    return tidy(topology.attach_topology_as_of(days.window_of_days(rows, wanted[0], 9), days.as_of(groups, wanted, 4, 1).drop("date")))


def read_days_skip(spark, sf):
    return tidy(days.window_of_days(_event_days(spark, sf), "2024-01-28", 7))


def read_days_strict(spark, sf):
    rows = _event_days(spark, sf).drop("event_id")
    return tidy(days.window_of_days(rows, "2024-01-10", 4, on_missing="error", dedup=True))


def missing_days(spark, sf):
    return tidy(days.missing_days(_event_days(spark, sf), "2024-01-25", 12))


# --- cohorts, windows, datasets -------------------------------------------------------------------


def model_snapshot(spark, sf):
    groups = _groups(spark, sf)
    homes = groups.select(
        F.substring("dg_rowkey", 6, 100).alias("serial_num"),
        F.concat_ws("/", "dg_model", "firmware").alias("dg_model_indiv"),
    )
    return tidy(cohort.model_snapshot(A.telemetry(spark, sf), homes, "Brand#3/fw7"))


def device_features(spark, sf):
    return tidy(features.device_features(telemetry_ops.metric_telemetry(A.station_history(spark, sf))))


def flag_window(spark, sf):
    return cohort.flag_window(A.device_days(spark, sf), COHORT_INSTALL, COHORT_DAYS)


def cohort_flags(spark, sf):
    return cohort.rolling_cohort(A.device_days(spark, sf), COHORT_INSTALL, COHORT_DAYS)


def cohort_flags_install(spark, sf):
    return cohort.rolling_cohort(
        A.device_days(spark, sf), COHORT_INSTALL, COHORT_DAYS + 1, after_phase="install", first_offset=1
    )


def cohort_counts(spark, sf):
    return _count_cohort(spark, sf)


def cohort_counts_published(spark, sf):
    """One model on each of 7 days, two on each of 8: users stand for homes, some miss the rule by a day."""
    users = A.table(spark, sf, "events").select("user_id").distinct()
    day = F.explode(F.sequence(F.lit(0), F.lit(14))).alias("day")
    two = (F.col("day") >= 7) | ((F.col("user_id") % 3 == 1) & (F.col("day") == 5))
    models = F.when(two, F.array(F.lit("router"), F.lit("extender"))).otherwise(F.array(F.lit("router")))
    rows = users.select("user_id", day).where(~((F.col("user_id") % 3 == 2) & (F.col("day") == 12)))
    homes = rows.select(
        A.serial(F.col("user_id")).alias("serial_num"),
        F.date_add(F.lit("2024-03-03").cast("date"), F.col("day")).alias("date"),
        F.explode(models).alias("dg_model_indiv"),
    )
    return cohort.cohort_by_counts(homes, "2024-03-10")


def cohort_counts_starts(spark, sf):
    """The rule of one model before and two after, for ten start days from one scan of the homes."""
    bitmaps = presence.row_count_bitmaps(A.home_days(spark, sf), "2024-01-01", 20, F.col("rows") <= 2, F.col("rows") >= 2)
    return tidy(presence.cohorts_by_counts(bitmaps, days.day_list("2024-01-05", 10), COUNT_BEFORE, COUNT_AFTER))


def cohort_counts_starts_published(spark, sf):
    """One model on each of 7 days, two on each of 8, for ten start days: users get an extender on different days."""
    users = A.table(spark, sf, "events").select("user_id").distinct()
    day = F.explode(F.sequence(F.lit(0), F.lit(29))).alias("day")
    models = F.when(F.col("day") >= 8 + F.col("user_id") % 7, F.array(F.lit("router"), F.lit("extender"))).otherwise(F.array(F.lit("router")))
    rows = users.select("user_id", day).where(~((F.col("user_id") % 5 == 4) & (F.col("day") == 16)))
    homes = rows.select(
        A.serial(F.col("user_id")).alias("serial_num"),
        F.date_add(F.lit("2024-03-01").cast("date"), F.col("day")).alias("date"),
        F.explode(models).alias("dg_model_indiv"),
    )
    bitmaps = presence.row_count_bitmaps(homes, "2024-03-01", 30)
    return tidy(presence.cohorts_by_counts(bitmaps, days.day_list("2024-03-08", 10)))


def cohort_flags_installs(spark, sf):
    """Homes that went on an extender around each of ten days, from one scan of the device days."""
    bitmaps = presence.flag_bitmaps(A.device_days(spark, sf), "2024-01-01", 24)
    return tidy(presence.cohorts_by_flags(bitmaps, days.day_list("2024-01-05", 10), COHORT_DAYS))


def homes_with_one_model(spark, sf):
    return tidy(cohort.homes_with_row_count(A.home_days(spark, sf), lambda rows: rows == 1))


def lowest_n(spark, sf):
    return tidy(features.lowest_n_mean(A.device_days(spark, sf), ["serial_num"]))


def total_volume(spark, sf):
    return tidy(
        A.device_days(spark, sf).groupBy("serial_num").agg(F.sum(F.exp("volume")).alias("total_volume"))
    )


def agg_device_window(spark, sf):
    return tidy(features.device_window(_device_days(spark, sf, WINDOW_START), total_volume=True))


def agg_home_window(spark, sf):
    homes = _home_days(spark, sf, WINDOW_START)
    return tidy(features.home_window(homes, MODELS, per_model=True, stations=True))


def _states(spark: SparkSession, sf: str, start: str) -> tuple[DataFrame, DataFrame]:
    """Daily states of all homes, and their value counts, for a week of a table of all days."""
    devices = A.device_days(spark, sf)
    tables = staging.stage(states.device_states(devices), "device-states"), staging.stage(states.value_states(devices), "value-states")
    return tuple(days.window_of_days(t, start, WINDOW_DAYS) for t in tables)


def device_day_states(spark, sf):
    rows = states.device_states(A.device_days(spark, sf), ("avg_phyrate", "volume", "avg_sig_strength_cat3"))
    return tidy(rows.withColumn("lowest", F.array_join("lowest", ",")))


def agg_device_window_states(spark, sf):
    """`agg_device_window` from daily states."""
    return tidy(states.device_window(*_states(spark, sf, WINDOW_START), total_volume=True))


def agg_home_window_states(spark, sf):
    """`agg_home_window` from daily states."""
    homes = staging.stage(states.home_states(A.home_days(spark, sf)), "home-states")
    return tidy(states.home_window(days.window_of_days(homes, WINDOW_START, WINDOW_DAYS), MODELS, per_model=True, stations=True))


def router_population_states(spark, sf):
    """`router_population` from daily states."""
    homes = staging.stage(states.home_states(A.home_days(spark, sf)), "home-states")
    return tidy(states.router_population(*_states(spark, sf, "2024-01-15"), homes, POPULATION_DAY, WINDOW_DAYS, MODELS))


def exact_medians(spark, sf):
    """Medians of order values by priority: few groups with very many distinct values, narrowed down by ranges."""
    orders = A.table(spark, sf, "orders").select("o_orderpriority", "o_totalprice", (F.col("o_custkey") * -1.0).alias("minus_customer"))
    keys = ["o_orderpriority"]
    found = medians.medians(staging.stage(medians.value_counts(orders, keys, ["o_totalprice", "minus_customer"]), "values"), keys, at_once=100)
    return tidy(found)


def training_set(spark, sf):
    devices, homes = A.device_days(spark, sf), A.home_days(spark, sf)
    members = staging.stage(cohort.rolling_cohort(devices, COHORT_INSTALL, COHORT_DAYS), "cohort")
    return tidy(
        dataset.before_after_set(devices, homes, members, "2024-01-07", "2024-01-13", COHORT_DAYS)
    )


def training_set_bucketed(spark, sf):
    """`training_set` on tables stored in buckets of homes."""
    name = staging.new_path(spark, "b").rsplit("/", 1)[1].replace("-", "_")
    tables = [
        bucketed.write_bucketed(rows, f"{name}_{kind}", staging.new_path(spark, kind), 8)
        for kind, rows in (("devices", A.device_days(spark, sf)), ("homes", A.home_days(spark, sf)))
    ]
    members = staging.stage(cohort.rolling_cohort(tables[0], COHORT_INSTALL, COHORT_DAYS), "cohort")
    return tidy(dataset.before_after_set(*tables, members, "2024-01-07", "2024-01-13", COHORT_DAYS))


def install_list(spark, sf):
    rows = dataset.install_set(
        A.device_days(spark, sf),
        A.home_days(spark, sf),
        staging.stage(_count_cohort(spark, sf), "install-cohort"),
        COUNT_START,
        MODELS,
        COUNT_BEFORE,
        COUNT_AFTER,
    )
    return tidy(rows)


def router_population(spark, sf):
    return tidy(
        dataset.router_population(
            A.device_days(spark, sf), A.home_days(spark, sf), POPULATION_DAY, WINDOW_DAYS, MODELS
        )
    )


def model_family(spark, sf):
    homes = A.home_days(spark, sf).select("date", "serial_num", "dg_model_indiv", "home_score")
    return tidy(report.model_family(homes, FAMILIES))


# --- reports --------------------------------------------------------------------------------------


def _order_homes(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("serial_num"),
        (F.col("o_totalprice") / 5000).alias("home_score"),
        F.col("o_orderpriority").alias("dg_model_indiv"),
        F.to_date("o_orderdate").alias("date"),
    )


def report_month_model(spark, sf):
    return tidy(report.month_model(_order_homes(spark, sf), PRIORITIES))


def report_day_model(spark, sf):
    return tidy(report.day_model(A.home_days(spark, sf), MODELS))


def report_day_model_listed(spark, sf):
    return tidy(report.day_model(A.home_days(spark, sf), MODELS[::-1], in_list_order=True))


def report_subscribers(spark, sf):
    return tidy(report.subscriber_history(_home_days(spark, sf, WINDOW_START, 20), MDNS))


def report_model_extract(spark, sf):
    return tidy(report.model_extract(_home_days(spark, sf, "2024-01-24"), MDNS, MODELS))


def increment_distribution(spark, sf):
    return tidy(report.increment_distribution(report.predicted_improved(_training(spark, sf), RULE)))


def feature_bins(spark, sf):
    return tidy(report.feature_bins(_training(spark, sf)))


def rule_classifier(spark, sf):
    return tidy(report.rule_summary(_training(spark, sf), RULE))


def rule_classifier_published(spark, sf):
    """The rule by its own count of readings, on homes with ten times as many device days."""
    rule = ImprovementRule(RULE.avg_phyrate_below, RULE.poor_phyrate_above, RULE.poor_rssi_above)
    return tidy(report.rule_summary(_training(spark, sf).withColumn("count", F.col("count") * 10), rule))


def rule_selected(spark, sf):
    chosen = report.predicted_improved(_training(spark, sf), RULE)
    return tidy(chosen.select("serial_num", *SWEEP_FEATURES, "score_increment"))


def histogram(spark, sf):
    chosen = report.predicted_improved(_training(spark, sf), RULE)
    return tidy(report.histogram(chosen, "score_increment", -20, 50, 20))


# --- model ----------------------------------------------------------------------------------------


def label_sweep(spark, sf):
    return tidy(model.label_sweep(_training(spark, sf)))


def label_counts(spark, sf):
    return tidy(model.label_counts(model.enhance_label(_training(spark, sf), 5)))


def hash_split(spark, sf):
    return model.with_split(_training(spark, sf).select("serial_num"))


def class_weights(spark, sf):
    split = model.with_split(model.enhance_label(_training(spark, sf)))
    return tidy(model.class_weights(split.where("NOT is_test")))


def _rule_predictions(spark: SparkSession, sf: str) -> DataFrame:
    labelled = model.enhance_label(_training(spark, sf))
    return labelled.withColumn("prediction", F.coalesce(report.selects(RULE), F.lit(False)).cast("int"))


def confusion_matrix(spark, sf):
    return model.confusion(_rule_predictions(spark, sf))


def confusion_metrics(spark, sf):
    return tidy(model.classification_metrics(_rule_predictions(spark, sf)))


def impute_mean(spark, sf):
    columns = ["avg_sig_strength_cat1", "avg_sig_strength_cat2"]
    days_ = A.device_days(spark, sf).select("date", "station_mac", *columns)
    return tidy(model.impute_mean(days_, columns))


def population_rows(spark, sf):
    population = dataset.router_population(
        A.device_days(spark, sf), A.home_days(spark, sf), POPULATION_DAY, WINDOW_DAYS
    )
    return tidy(model.population_rows(population).select("serial_num", *RecommendationRules().features))


def _population(spark: SparkSession, sf: str) -> DataFrame:
    return dataset.router_population(
        A.device_days(spark, sf), A.home_days(spark, sf), POPULATION_DAY, WINDOW_DAYS
    )


def _staged_training(spark: SparkSession, sf: str, count: int = WINDOW_DAYS, after: str = AFTER_START):
    """Training reads its rows once per pass, so they are written first."""
    return staging.stage(_training(spark, sf, count, after), "training")


def _learned(spark: SparkSession, sf: str, **rules) -> tuple:
    """The recommendation's forest and the rows it was split from."""
    how = RecommendationRules(**rules)
    split = model.with_split(model.training_rows(_staged_training(spark, sf), rules=how))
    return model.fit_forest(split.where("NOT is_test"), how.features, how.imputed, how.forest), split


def rf_scores(spark, sf):
    """Scored homes: whether each has a score, and whether the fitted trees, followed as a table, give the same."""
    fitted, _ = _learned(spark, sf)
    homes = staging.stage(model.population_rows(_population(spark, sf)), "population")
    scored = model.score_population(fitted, homes)
    followed = trees.score_with_trees(fitted, homes).withColumnRenamed("extender_score", "followed")
    same = F.col("extender_score").eqNullSafe(F.col("followed")).alias("same_by_table")
    return scored.join(followed, "serial_num").select("serial_num", F.col("extender_score").between(0, 1).alias("scored"), same)


def rf_metrics(spark, sf):
    """Hold-out supports, whether the trees as a table give the same figures, and whether anything was learned.

    Learned: on the rows it was trained with, the forest finds more than half of both classes together.
    """
    fitted, split = _learned(spark, sf)
    test, train = split.where("is_test"), split.where("NOT is_test")
    found = model.classification_metrics(model.with_prediction(fitted, test))
    again = model.classification_metrics(trees.predict_with_trees(fitted, test)).select("label", *[F.col(c).alias(f"t_{c}") for c in ("precision", "recall", "accuracy")])
    same = [F.col(c).eqNullSafe(F.col(f"t_{c}")) for c in ("precision", "recall", "accuracy")]
    recalls = model.classification_metrics(trees.predict_with_trees(fitted, train)).agg(F.avg("recall").alias("found")).scalar()
    return found.join(again, "label").select(
        "label", "support", F.col("accuracy").between(0, 1).alias("measured"), (same[0] & same[1] & same[2]).alias("same_by_table"), (recalls > 0.5).alias("learned")
    )


# A small forest as a table: tree, node, feature, threshold, left, right, weight of class 0, weight of class 1.
SMALL_FOREST = (
    (0, 0, "avg_phyrate", 310.5, 1, 2, 0.0, 0.0),
    (0, 1, "poor_rssi", 24.0, 3, 4, 0.0, 0.0),
    (0, 2, None, None, None, None, 30.0, 10.0),
    (0, 3, None, None, None, None, 5.0, 15.0),
    (0, 4, None, None, None, None, 3.0, 24.0),
    (1, 0, "count", 14.0, 1, 2, 0.0, 0.0),
    (1, 1, None, None, None, None, 12.0, 4.0),
    (1, 2, "volume", 2.75, 3, 4, 0.0, 0.0),
    (1, 3, None, None, None, None, 8.0, 2.0),
    (1, 4, None, None, None, None, 7.0, 7.0),
    (2, 0, None, None, None, None, 11.0, 9.0),
)


def forest_table_scores(spark, sf):
    """Homes scored by following a forest that is given as a table."""
    nodes = spark.createDataFrame(SMALL_FOREST, "tree int, node int, feature string, threshold double, left int, right int, weight_0 double, weight_1 double")
    chance = F.round(trees.forest_probability(nodes), 4)
    return _population(spark, sf).select("serial_num", chance.alias("extender_score"))


def lr_scores(spark, sf):
    """Scores of all homes by the fitted coefficients, and whether the loss has no gradient there."""
    split = staging.stage(model.with_split(model.enhance_label(_staged_training(spark, sf))), "split")
    fitted = model.fit_logistic(split.where("NOT is_test"))
    scored = model.score_population(fitted, split, [model.LABEL, "is_test"])
    steep = model.logistic_gradient(fitted, split.where("NOT is_test")).agg(F.max(F.abs(F.col("gradient")) / F.col("scale")).alias("steep"))
    return scored.select("serial_num", model.LABEL, "is_test", "extender_score", (steep.scalar() < 1e-5).alias("at_optimum"))


def rf_population_share(spark, sf):
    """Per threshold the homes predicted either way, which are all of the population, and whether the tree
    table predicts as many of them to improve."""
    training, homes = _staged_training(spark, sf), staging.stage(_population(spark, sf), "population")
    shares = model.population_share(training, homes)
    parts = []
    for threshold in (0, 5, 10):
        fitted = model.fit_forest(model.with_split(model.enhance_label(training, threshold)).where("NOT is_test"))
        parts.append(trees.predict_with_trees(fitted, homes).agg(F.count_if(F.col("prediction") == 1).alias("t_ones")).select(F.lit(threshold).alias("threshold"), "t_ones"))
    joined = shares.join(files.union_all(parts), "threshold")
    return joined.select("threshold", (F.col("zeros") + F.col("ones")).alias("homes"), (F.col("ones") == F.col("t_ones")).alias("same_by_table"))


def window_sweep(spark, sf):
    """Supports of every window and threshold, and whether the tree tables give the same hold-out figures."""
    trainings = {
        count: _staged_training(spark, sf, count, after) for count, after in ((3, "2024-01-07"), (7, AFTER_START))
    }
    swept = model.window_sweep(trainings, thresholds=(0, 5))
    parts = []
    for count, training in trainings.items():
        for threshold in (0, 5):
            split = model.with_split(model.enhance_label(training, threshold))
            fitted = model.fit_forest(split.where("NOT is_test"))
            again = model.classification_metrics(trees.predict_with_trees(fitted, split.where("is_test")))
            parts.append(again.select(F.lit(count).alias("window_days"), F.lit(threshold).alias("threshold"), "label", F.col("recall").alias("t_recall"), F.col("precision").alias("t_precision")))
    same = F.col("recall").eqNullSafe(F.col("t_recall")) & F.col("precision").eqNullSafe(F.col("t_precision"))
    joined = swept.join(files.union_all(parts), ["window_days", "threshold", "label"])
    return joined.select("window_days", "threshold", "label", "support", same.alias("same_by_table"))


# --- files ----------------------------------------------------------------------------------------


def json_roundtrip(spark, sf):
    orders = A.table(spark, sf, "orders").withColumn("o_orderdate", F.to_date("o_orderdate"))
    nested = orders.select("o_orderkey", F.struct(*[c for c in orders.columns if c != "o_orderkey"]).alias("o"))
    path = staging.new_path(spark, "json")
    sinks.write_table(nested, path, fmt="json")
    return tidy(reshape.flatten_structs(files.read_json(spark, path, nested.schema)))


def csv_roundtrip(spark, sf):
    part = A.table(spark, sf, "part")
    path = staging.new_path(spark, "csv")
    sinks.write_table(part, f"{path}/a/b", {"header": "true"}, fmt="csv")
    return tidy(files.read_csv(spark, path, recursive=True).withColumn("p_retailprice", F.col("p_retailprice").cast("double")))


_EVENT = T.StructType(
    [T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()), T.StructField("day", T.StringType()), T.StructField("value", T.DoubleType())]
)


def _event_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Events in the shape of the file formats, with odd ones among them marked by `odd`."""
    k = F.col("event_id")
    odd = F.when(k % 11 == 0, "cut").when(k % 13 == 0, "typed").when(k % 17 == 0, "nameless").when(k % 19 == 0, "far")
    return _event_days(spark, sf).select(
        "event_id", F.when(odd.eqNullSafe("nameless"), None).otherwise(F.col("user_id")).alias("user_id"), F.col("date").cast("string").alias("day"),
        F.when(odd.eqNullSafe("far"), 1e9).otherwise(F.col("event_id") / 4).alias("value"), odd.alias("odd"),
    )


def bad_json_lines(spark, sf):
    """JSON with broken lines, values of the wrong type, missing ids and values out of range: counts by day and reason."""
    whole = F.to_json(F.struct("event_id", "user_id", "day", "value"))
    line = F.when(F.col("odd") == "cut", F.expr("substring(line, 1, length(line) - 6)")).when(F.col("odd") == "typed", F.replace("line", F.lit('"event_id":'), F.lit('"event_id":"x"')))
    path = staging.new_path(spark, "lines")
    _event_lines(spark, sf).select(whole.alias("line"), "odd").select(F.coalesce(line, "line").alias("value")).write.text(path)
    marked = files.read_marked(spark, path, _EVENT, "json", ("user_id",), {"too large": F.col("value") > 1e8})
    good = files.set_aside(staging.stage(marked, "marked"), staging.new_path(spark, "aside"))
    aside = files.reason_counts(marked).where("reason <> 'good'").select(F.lit(None).cast("string").alias("day"), "reason", "count")
    return good.groupBy("day").agg(F.count("*").alias("count")).select("day", F.lit("good").alias("reason"), "count").union(aside)


def bad_csv_lines(spark, sf):
    """CSV with missing fields and values of the wrong type: counts by reason."""
    value = F.when(F.col("odd") == "typed", "much").otherwise(F.col("value").cast("string"))
    fields = F.concat_ws(",", "event_id", F.coalesce(F.col("user_id").cast("string"), F.lit("")), "day", value)
    short = F.concat_ws(",", "event_id", "user_id")
    path = staging.new_path(spark, "lines")
    _event_lines(spark, sf).select(F.when(F.col("odd") == "cut", short).otherwise(fields).alias("value")).write.text(path)
    # lines without a header: the schema names the fields
    marked = files.read_marked(spark, path, _EVENT, "csv", ("user_id",), {"too large": F.col("value") > 1e8}, header=False)
    return files.reason_counts(marked)


def parquet_overwrite_day(spark, sf):
    """Write all days, write two of them again with other rows, and count what is there."""
    path = staging.new_path(spark, "days")
    events = _event_days(spark, sf)
    sinks.overwrite_days(events, path)
    again = days.window_of_days(events, "2024-01-03", 2).where(F.col("event_type") == "click")
    sinks.overwrite_days(again, path)
    stored = spark.read.parquet(path)
    return tidy(stored.groupBy("date", "event_type").agg(F.count("*").alias("count")))


def read_day_folders(spark, sf):
    """One folder per day, the last days of the range missing."""
    path = staging.new_path(spark, "folders")
    sinks.overwrite_days(_event_days(spark, sf), path)
    rows = files.read_day_folders(spark, path + "/date={}", "2024-01-26", 10)
    return tidy(rows.groupBy("date", "event_type").agg(F.count("*").alias("count")))


def read_day_files(spark, sf):
    """The same name in the folder of each day, as subscriber maps are delivered."""
    path = staging.new_path(spark, "files")
    for day in days.day_list("2024-01-02", 5):
        rows = _event_days(spark, sf).where(F.col("date") == F.lit(day)).drop("date")
        sinks.write_table(rows, f"{path}/{day}/map.csv", {"header": "true"}, fmt="csv")
    read = files.read_day_folders(spark, path + "/{}/map.csv", "2024-01-01", 5, fmt="csv")
    return tidy(read.groupBy("date", "event_type").agg(F.count("*").alias("count")))


def overwrite_empty_day(spark, sf):
    """Three days written again with rows for one of them: the other two end up empty."""
    path = staging.new_path(spark, "emptied")
    events = _event_days(spark, sf)
    sinks.overwrite_days(events, path)
    again = events.where(F.col("date") == "2024-01-04")
    sinks.overwrite_days(again, path, days=["2024-01-03", "2024-01-04", "2024-01-05"])
    return tidy(spark.read.parquet(path).groupBy("date").agg(F.count("*").alias("count")))


def published_days(spark, sf):
    """Days published as a whole, one of them again with other rows, one again but not to the end."""
    store = staging.new_path(spark, "store")
    rows = _event_days(spark, sf)

    def draft(day: str, kept: str) -> published.Draft:
        made = published.Draft(spark, store, day)
        found = made.write("rows", rows.where((F.col("date") == day) & F.expr(kept)))
        made.write("counts", found.groupBy("event_type").agg(F.count("*").alias("n")))
        return made

    for day in days.day_list("2024-01-02", 3):
        draft(str(day), "true").publish()
    draft("2024-01-03", "event_type = 'click'").publish()
    draft("2024-01-04", "event_type = 'view'")  # a job that stops here leaves the day as it was
    stored = published.read_published(spark, store, "rows").groupBy("date", "event_type").agg(F.count("*").alias("count"))
    counts = published.read_published(spark, store, "counts", "2024-01-03", 2)
    return tidy(stored.join(counts, ["date", "event_type"], "left"))


def overwrite_files(spark, sf):
    """Days written by a given number of tasks and read back."""
    path = staging.new_path(spark, "sized")
    sinks.overwrite_days(_event_days(spark, sf), path, files=2)
    return tidy(spark.read.parquet(path).groupBy("date").agg(F.count("*").alias("count")))


def window_dataset(spark, sf):
    """A training set stored under the days of its window."""
    path = staging.new_path(spark, "window")
    rows = _training(spark, sf).select("serial_num", "score_increment")
    sinks.overwrite_window(rows, path, "2024-01-08", WINDOW_DAYS)
    names = ("before_date", "install_date", "after_date", "window_days")
    return tidy(spark.read.parquet(path).select("serial_num", "score_increment", *names))


def report_csv(spark, sf):
    """A subscriber report written as one CSV file and read back."""
    path = staging.new_path(spark, "report")
    sinks.write_report_csv(report_subscribers(spark, sf), path)
    return tidy(files.read_csv(spark, path).withColumn("home_score", F.col("home_score").cast("double")))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        telemetry_parse,
        telemetry_complete,
        flatten_struct,
        flatten_arrays,
        explode_groups,
        explode_nested,
        row_keys,
        cast_rename_map,
        cast_all_but,
        round_columns,
        epoch_ms_to_ts,
        poor_rssi,
        poor_phyrate,
        stationarity,
        stationarity_lenient,
        stationarity_exact,
        weights_a,
        weights_a_per_home,
        weights_b,
        weights_c,
        volume_share,
        identity_join,
        identity_inner,
        identity_left,
        topology_join,
        device_score_a,
        device_score_a_published,
        device_score_b,
        device_score_c,
        home_score_a,
        home_score_b,
        home_score_c,
        rescore_homes,
        home_from_detail,
        latest_snapshot,
        snapshots_as_of,
        identity_as_of,
        topology_as_of,
        snapshot_fallback,
        read_days_skip,
        read_days_strict,
        missing_days,
        model_snapshot,
        device_features,
        flag_window,
        cohort_flags,
        cohort_flags_install,
        cohort_counts,
        cohort_counts_published,
        cohort_counts_starts,
        cohort_counts_starts_published,
        cohort_flags_installs,
        homes_with_one_model,
        lowest_n,
        total_volume,
        agg_device_window,
        agg_home_window,
        device_day_states,
        agg_device_window_states,
        agg_home_window_states,
        router_population_states,
        exact_medians,
        training_set,
        install_list,
        router_population,
        model_family,
        report_month_model,
        report_day_model,
        report_day_model_listed,
        report_subscribers,
        report_model_extract,
        increment_distribution,
        feature_bins,
        rule_classifier,
        rule_classifier_published,
        rule_selected,
        histogram,
        label_sweep,
        label_counts,
        hash_split,
        class_weights,
        confusion_matrix,
        confusion_metrics,
        impute_mean,
        population_rows,
        rf_scores,
        rf_metrics,
        forest_table_scores,
        lr_scores,
        rf_population_share,
        window_sweep,
        json_roundtrip,
        csv_roundtrip,
        bad_json_lines,
        bad_csv_lines,
        training_set_bucketed,
        parquet_overwrite_day,
        read_day_folders,
        read_day_files,
        overwrite_empty_day,
        published_days,
        overwrite_files,
        window_dataset,
        report_csv,
    )
}
