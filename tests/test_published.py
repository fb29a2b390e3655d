"""Days whose tables become visible together."""

from dataclasses import asdict
from datetime import date, timedelta

import pytest

from homescore.operators import states
from homescore.plans import daily
from homescore.sources.published import Draft, newest, open_days, read_published
from tests.conftest import rows
from tests.test_daily import DAY, tables  # noqa: F401  (the fixture)

D1, D2 = date(2024, 3, 1), date(2024, 3, 2)


def day_rows(spark, *values):
    return spark.createDataFrame([(v, D1) for v in values], "v int, date date")


def publish(spark, store, day, *values):
    draft = Draft(spark, store, day)
    for name in ("a", "b"):
        draft.write(name, day_rows(spark, *values))
    draft.publish()


def test_newest_version_of_each_day(spark, tmp_path):
    store = str(tmp_path / "s")
    with pytest.raises(FileNotFoundError):
        read_published(spark, store, "a")
    publish(spark, store, D1, 1, 2)
    publish(spark, store, D2, 3)
    publish(spark, store, D1, 4)
    assert rows(read_published(spark, store, "a"), "date", "v") == rows(read_published(spark, store, "b"), "date", "v") == [(D1, 4), (D2, 3)]
    assert [r["seq"] for r in newest(spark, store).orderBy("date").collect()] == [2, 1]
    assert open_days(spark, store, [D1, D2, D2 + timedelta(1)]) == [D2 + timedelta(1)]


def test_a_draft_is_not_seen(spark, tmp_path):
    """One table of the day is written, then the job fails: readers have the old day whole."""
    store = str(tmp_path / "s")
    publish(spark, store, D1, 1, 2)
    Draft(spark, store, D1).write("a", day_rows(spark, 9))
    assert rows(read_published(spark, store, "a"), "v") == rows(read_published(spark, store, "b"), "v") == [(1,), (2,)]
    Draft(spark, store, D2).write("a", day_rows(spark, 9))
    assert open_days(spark, store, [D1, D2]) == [D2]


def test_a_day_without_rows_is_published_empty(spark, tmp_path):
    store = str(tmp_path / "s")
    publish(spark, store, D1, 1)
    publish(spark, store, D1)
    publish(spark, store, D2, 5)
    assert rows(read_published(spark, store, "a"), "date", "v") == [(D2, 5)]
    assert open_days(spark, store, [D1]) == []


def test_only_chosen_versions_are_scanned(spark, tmp_path):
    store = str(tmp_path / "s")
    for k in range(3):
        publish(spark, store, D1, k)
        publish(spark, store, D2, k)
    read = read_published(spark, store, "a", D1, 1)
    assert len(read.inputFiles()) == 1 and rows(read, "v") == [(2,)]


def failing_states(*args, **options):
    raise FileNotFoundError("gone")


def test_daily_job_publishes_whole_days(spark, tables, tmp_path, monkeypatch):  # noqa: F811
    """Scores, population and a day that fails half way, all through the store."""
    store = daily.PublishedTables(**{**asdict(tables), "router_population": str(tmp_path / "p")}, store=str(tmp_path / "s"))
    today = DAY + timedelta(1)
    assert daily.backfill_scores(spark, store, today, back=1).done == [DAY]
    before = rows(read_published(spark, store.store, "home_score"), "date", "serial_num", "dg_model_indiv", "home_score")
    assert len(before) == 2
    # device and home rows of the day before are written, its states are not: the day stays open
    with monkeypatch.context() as m:
        m.setattr(states, "home_states", failing_states)
        assert list(daily.backfill_scores(spark, store, today, back=2).failed) == [DAY - timedelta(1)]
        with pytest.raises(FileNotFoundError):
            daily.score_day(spark, store, DAY)
    for name in ("home_score", "device_score", "home_states"):
        assert {r[0] for r in rows(read_published(spark, store.store, name), "date")} == {DAY}
    assert rows(read_published(spark, store.store, "home_score"), "date", "serial_num", "dg_model_indiv", "home_score") == before
    assert daily.backfill_scores(spark, store, today, back=2).done == [DAY - timedelta(1)]
    daily.population_day(spark, store, DAY + timedelta(1), ["router"])
    population = spark.read.parquet(store.router_population)
    assert rows(population, "serial_num", "before_home_score", "count") == [("SERIAL00001", 100.0, 4)]


def test_population_reads_states_only(spark, tables, tmp_path):  # noqa: F811
    store = daily.PublishedTables(**asdict(tables), store=str(tmp_path / "s"))
    daily.backfill_scores(spark, store, DAY + timedelta(1), back=2)
    merged = [read_published(spark, store.store, n) for n in ("device_states", "value_states", "home_states")]
    files = " ".join(states.router_population(*merged, DAY + timedelta(1), 7, ["router"]).inputFiles())
    assert "/device_score/" not in files and "/home_score/" not in files
    assert all(f"/{name}/" in files for name in ("device_states", "value_states", "home_states"))


def test_states_say_what_the_rows_say(spark, tables, tmp_path):  # noqa: F811
    """The population from states equals the one from device rows."""
    plain = daily.Tables(**{**asdict(tables), "router_population": str(tmp_path / "p1"), "home_score": str(tmp_path / "h"), "device_score": str(tmp_path / "d")})
    store = daily.PublishedTables(**{**asdict(tables), "router_population": str(tmp_path / "p2")}, store=str(tmp_path / "s"))
    for t in (plain, store):
        daily.backfill_scores(spark, t, DAY + timedelta(1), back=2)
        daily.population_day(spark, t, DAY + timedelta(1), ["router"])
    columns = spark.read.parquet(plain.router_population).columns
    assert rows(spark.read.parquet(plain.router_population), *columns) == rows(spark.read.parquet(store.router_population), *columns)
