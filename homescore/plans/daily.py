"""The daily job: scores, population, install list and recommendation, in their order."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import date, timedelta

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from homescore.config import ModelFamilies
from homescore.operators import dataset, model, presence, score, states
from homescore.operators.cohort import cohort_by_counts, rolling_cohort
from homescore.operators.features import device_features
from homescore.operators.kpi import device_kpis
from homescore.operators.reshape import stamp_date
from homescore.operators.telemetry import metric_telemetry, telemetry
from homescore.operators.topology import device_groups, subscriber_identity
from homescore.schemas import DEVICE_GROUPS, STATION_HISTORY, SUBSCRIBER_MAP, dated
from homescore.sources import days as D
from homescore.sources.published import Draft, open_days, read_published
from homescore.sources.sinks import overwrite_days, overwrite_window
from homescore.sources.staging import stage


@dataclass(frozen=True)
class Tables:
    """Paths of the inputs and outputs; every table is partitioned by `date`."""

    station_history: str
    device_groups: str
    subscriber_map: str
    device_score: str
    home_score: str
    router_population: str
    install_list: str
    extender_score: str
    store = ""  # scores are tables of their own


@dataclass(frozen=True)
class PublishedTables(Tables):
    """Scores of a day are published together in `store`, with daily states from which windows are merged;
    `device_score` and `home_score` are not used."""

    store: str = ""


def _table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    return (spark.read if schema is None else spark.read.schema(dated(schema))).parquet(path)


def score_day(
    spark: SparkSession,
    tables: Tables,
    day: date | str,
    identity_back: int = 5,
    groups_back: int = 5,
    files: int | None = None,
) -> None:
    """Variant C scores of `day`. Readings of a day are delivered under the next day's date."""
    delivered = D.as_day(day) + timedelta(1)
    history = _table(spark, tables.station_history, STATION_HISTORY).where(F.col("date") == F.lit(delivered))
    mapping = _table(spark, tables.subscriber_map, SUBSCRIBER_MAP)
    groups = _table(spark, tables.device_groups, DEVICE_GROUPS)
    mapped_on = D.latest_day(mapping, delivered, identity_back, 1)
    grouped_on = D.latest_day(groups, delivered, groups_back)
    located = score.located_devices_c(
        stage(device_kpis(telemetry(history, complete=True)), "device-kpis"),
        device_groups(groups.where(F.col("date") == F.lit(grouped_on))),
        subscriber_identity(mapping.where(F.col("date") == F.lit(mapped_on))),
    )
    # Weights and two outputs are made from the device rows.
    devices = score.device_scores_c(stage(located, "located-devices"))
    if tables.store:
        publish_day(spark, tables.store, day, score.rounded_device_scores(devices), score.home_scores(devices), files)
        return
    overwrite_days(stamp_date(score.rounded_device_scores(devices), str(day)), tables.device_score, files=files, days=[day])
    overwrite_days(stamp_date(score.home_scores(devices), str(day)), tables.home_score, files=files, days=[day])


def publish_day(spark: SparkSession, store: str, day: date | str, devices: DataFrame, homes: DataFrame, files: int | None = None) -> None:
    """Make the device rows, home rows and states of a day visible together."""
    draft = Draft(spark, store, day)
    stored = draft.write("device_score", devices, files).withColumn("date", F.lit(draft.day))
    scored = draft.write("home_score", homes, files).withColumn("date", F.lit(draft.day))
    draft.write("device_states", states.device_states(stored))
    draft.write("value_states", states.value_states(stored))
    draft.write("home_states", states.home_states(scored))
    draft.publish()


def _scores(spark: SparkSession, tables: Tables, name: str) -> DataFrame:
    """Stored rows of `device_score` or `home_score`, with their date."""
    return read_published(spark, tables.store, name) if tables.store else _table(spark, getattr(tables, name))


@dataclass
class Outcome:
    """Days a job wrote, and those it could not, with the reason."""

    done: list[date] = field(default_factory=list)
    failed: dict[date, str] = field(default_factory=dict)


def each_day(todo: Sequence[date], job: Callable[[date], None]) -> Outcome:
    """Run `job` for every day; a day that fails is recorded and the others still run."""
    outcome = Outcome()
    for day in todo:
        try:
            job(day)
        except (FileNotFoundError, PySparkException, Py4JError) as error:
            outcome.failed[day] = f"{type(error).__name__}: {error}"
        else:
            outcome.done.append(day)
    return outcome


def _open_days(spark: SparkSession, paths: Sequence[str], first: date, count: int) -> list[date]:
    """Days without rows in any of the tables, latest first."""
    todo = set(D.day_list(first, count))
    for written in (D.table_or_none(spark, path) for path in paths):
        if written is not None:
            todo &= set(D.days_without_rows(written, first, count))
    return sorted(todo, reverse=True)


def backfill_scores(
    spark: SparkSession, tables: Tables, today: date | str, back: int = 9, archive: str | None = None, **options
) -> Outcome:
    """Score every one of the last `back` days that has no home scores yet, here or in the archive."""
    first = D.as_day(today) - timedelta(back)
    places = [] if tables.store else [tables.home_score]
    todo = _open_days(spark, places if archive is None else [*places, archive], first, back)
    if tables.store:
        todo = open_days(spark, tables.store, todo)
    return each_day(todo, lambda day: score_day(spark, tables, day, **options))


def features_day(spark: SparkSession, history: str, path: str, day: date | str) -> None:
    """Mean and deviation of every metric per device of a day, from the readings delivered a day later."""
    delivered = D.as_day(day) + timedelta(1)
    readings = metric_telemetry(_table(spark, history, STATION_HISTORY).where(F.col("date") == F.lit(delivered)))
    overwrite_days(stamp_date(device_features(readings), str(day)), path, days=[day])


def training_dataset(
    spark: SparkSession, tables: Tables, path: str, install: date | str, window: int = 7
) -> None:
    """Before / after rows of the homes that got an extender around `install`, named by their window."""
    first = D.as_day(install)
    devices, homes = _scores(spark, tables, "device_score"), _scores(spark, tables, "home_score")
    members = stage(rolling_cohort(devices, first, window), "cohort")
    before, after = first - timedelta(window), first + timedelta(window)
    rows = dataset.before_after_set(devices, homes, members, before, after, window)
    overwrite_window(rows, path, first, window)


def population_day(
    spark: SparkSession, tables: Tables, day: date | str, routers: Sequence[str], window: int = 7
) -> None:
    if tables.store:
        first = D.as_day(day) - timedelta(window)
        merged = [read_published(spark, tables.store, name, first, window) for name in ("device_states", "value_states", "home_states")]
        rows = states.router_population(*merged, day, window, routers)
    else:
        rows = dataset.router_population(
            _table(spark, tables.device_score), _table(spark, tables.home_score), day, window, routers
        )
    overwrite_days(stamp_date(rows, str(day)), tables.router_population, days=[day])


def install_list_day(
    spark: SparkSession, tables: Tables, start: date | str, routers: Sequence[str], cohorts: DataFrame | None = None
) -> None:
    """Training rows of the homes that installed an extender on `start`; all days around it must exist.

    `cohorts` (serial_num, start) names the homes of several start days; without it they are found here.
    """
    first = D.as_day(start)
    homes = _scores(spark, tables, "home_score")
    D.window_of_days(homes, first - timedelta(7), 15, on_missing="error")
    if cohorts is None:
        cohort = stage(cohort_by_counts(homes, first), "install-cohort")
    else:
        cohort = cohorts.where(F.col("start") == F.lit(first)).select("serial_num")
    rows = dataset.install_set(_scores(spark, tables, "device_score"), homes, cohort, first, routers)
    overwrite_days(stamp_date(rows, str(first)), tables.install_list, days=[first])


def recommend_day(spark: SparkSession, tables: Tables, day: date | str, families: ModelFamilies) -> DataFrame:
    """Train on all installs so far, score the population of `day` and return the hold-out metrics."""
    population = _table(spark, tables.router_population).where(F.col("date") == F.lit(D.as_day(day)))
    metrics, scored = model.recommend(_table(spark, tables.install_list), population.drop("date"), families)
    overwrite_days(stamp_date(scored, str(day)), tables.extender_score, days=[day])
    return metrics


def backfill_install_lists(
    spark: SparkSession, tables: Tables, today: date | str, routers: Sequence[str], back: int = 10
) -> Outcome:
    """Install lists of the last `back` start days whose days after it are over and that have none yet.

    The homes of all these days come from one scan of the home scores.
    """
    first = D.as_day(today) - timedelta(8 + back - 1)
    todo = _open_days(spark, [tables.install_list], first, back)
    found: list[DataFrame] = []

    def job(day: date) -> None:
        if not found:
            bitmaps = presence.row_count_bitmaps(_scores(spark, tables, "home_score"), first - timedelta(7), back + 14)
            found.append(stage(presence.cohorts_by_counts(bitmaps, todo), "install-cohorts"))
        install_list_day(spark, tables, day, routers, found[0])

    return each_day(todo, job)


def run_day(
    spark: SparkSession, tables: Tables, today: date | str, families: ModelFamilies
) -> tuple[DataFrame | None, dict[str, Outcome]]:
    """Scores first; the population and the install lists follow; the recommendation comes last.

    Every step runs whatever became of the others' days. Returns the hold-out metrics, None if the
    recommendation failed, and the outcome of each step.
    """
    yesterday = D.as_day(today) - timedelta(1)
    metrics: list[DataFrame] = []
    outcomes = {
        "scores": backfill_scores(spark, tables, today),
        "population": each_day([yesterday], lambda day: population_day(spark, tables, day, families.routers)),
        "installs": backfill_install_lists(spark, tables, today, families.routers),
        "recommendation": each_day([yesterday], lambda day: metrics.append(recommend_day(spark, tables, day, families))),
    }
    return (metrics[0] if metrics else None), outcomes
