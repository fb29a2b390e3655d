"""Wall time of the headline queries, as one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose tables and cores. BENCH_LITERAL=1 times the KPI step in its
written-out form (window percentiles, three scans, joins) next to the single pass instead.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from homescore import adapter
from homescore.config import DEVICE_KEYS, KpiRules
from homescore.operators import kpi
from homescore.plans.queries import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "telemetry_parse",
    "explode_groups",
    "poor_rssi",
    "poor_phyrate",
    "stationarity",
    "stationarity_exact",
    "weights_a",
    "weights_b",
    "weights_c",
    "topology_join",
    "device_score_b",
    "home_score_a",
    "home_score_b",
    "home_score_c",
    "device_features",
    "cohort_flags",
    "cohort_counts",
    "agg_device_window",
    "agg_home_window",
    "training_set",
    "router_population",
    "report_month_model",
    "feature_bins",
    "rf_scores",
)


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def seconds(make) -> float:
    start = time.perf_counter()
    make().write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def literal_kpis(telemetry: DataFrame, rules: KpiRules = KpiRules()) -> DataFrame:
    """The KPI step as separate passes over the telemetry, joined on the device."""
    keys = list(DEVICE_KEYS)
    device = Window.partitionBy(*keys)
    low, p10, mid, p90 = (F.percentile_approx(kpi.RSSI, p).over(device) for p in rules.percentiles)
    marked = telemetry.withColumns({"p3": low, "p10": p10, "p50": mid, "p90": p90})
    kept = marked.where(F.col(kpi.RSSI) > F.least(F.expr("p10 - 2 * (p90 - p10)"), F.col("p3")))
    steady = kept.groupBy(*keys).agg(F.max(F.when(F.expr("p90 - p50 <= 5"), 1).otherwise(0)).alias("stationarity"))
    heard = telemetry.groupBy(*keys).agg(
        F.count(kpi.RSSI).alias("n_rssi"), F.count_if(kpi.weak_signal(rules)).alias("n_weak")
    )
    rated = telemetry.where(kpi.valid_rate(rules)).groupBy(*keys).agg(
        F.avg(kpi.RATE).alias("avg_phyrate"), F.count_if(F.col(kpi.RATE) < rules.slow_rate).alias("n_slow")
    )
    parents = telemetry.select(*keys, "parent_id").distinct().groupBy(*keys).agg(F.count("*").alias("n_parents"))
    return heard.where("n_rssi >= 36").join(rated, keys).join(steady, keys).join(parents, keys)


def single_pass(telemetry: DataFrame) -> DataFrame:
    return kpi.device_kpis(telemetry).where("n_rssi >= 36 AND n_phy > 0 AND kept")


def main() -> None:
    spark = session()
    if os.environ.get("BENCH_LITERAL"):
        telemetry = adapter.telemetry(spark, SF_DIR)
        forms = {"single_pass": single_pass, "literal": literal_kpis}
        times = {name: min(seconds(lambda f=form: f(telemetry)) for _ in range(3)) for name, form in forms.items()}
        metric = "kpi_step_forms"
    else:
        seconds(lambda: adapter.telemetry(spark, SF_DIR))
        times = {name: seconds(lambda q=QUERIES[name]: q(spark, SF_DIR)) for name in HEADLINE}
        metric = "headline_queries_total"
    print(
        json.dumps(
            {
                "metric": metric,
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
