"""Which days a home satisfies a condition, one bit a day: any window of days is then a bit test."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, timedelta
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homescore.sources.days import as_day, in_days

#: Days in one word of bits.
WORD = 62


def _words(days: int) -> int:
    return -(-days // WORD)


def presence(rows: DataFrame, first: date | str, days: int, conditions: Mapping[str, Column]) -> DataFrame:
    """serial_num and one bitmap a condition over `days` days from `first` on, from one scan.

    `rows` has serial_num, date and what the conditions look at. A bit is set where any row of the home
    and day satisfies the condition. A bitmap of more than 62 days takes several columns.
    """
    start = F.lit(as_day(first))
    day = F.date_diff("date", start)
    bits = []
    for name, condition in conditions.items():
        for word in range(_words(days)):
            inside = condition & day.between(word * WORD, word * WORD + WORD - 1)
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(day, F.lit(WORD)))
            bits.append(F.bit_or(F.when(inside, bit).otherwise(F.lit(0).cast("long"))).alias(f"{name}_{word}"))
    return rows.where(in_days(first, days)).groupBy("serial_num").agg(*bits)


def _masks(first: date | str, days: int, start: date, count: int) -> dict[int, int]:
    """The bits of each word that stand for `count` days from `start` on."""
    offset = (start - as_day(first)).days
    if count < 1 or offset < 0 or offset + count > days:
        raise ValueError(f"{count} days from {start} on are not within {days} days from {first} on")
    masks: dict[int, int] = {}
    for d in range(offset, offset + count):
        masks[d // WORD] = masks.get(d // WORD, 0) | 1 << d % WORD
    return masks


class Bitmaps:
    """A table of `presence` with the days it covers; its tests are conditions on that table."""

    def __init__(self, table: DataFrame, first: date | str, days: int) -> None:
        self.table, self.first, self.days = table, as_day(first), days

    def _parts(self, name: str, start: date | str, count: int) -> list[tuple[Column, int]]:
        masks = _masks(self.first, self.days, as_day(start), count)
        return [(F.col(f"{name}_{word}").bitwiseAND(F.lit(mask)), mask) for word, mask in masks.items()]

    def on_all(self, name: str, start: date | str, count: int) -> Column:
        """The condition holds on every day of the window."""
        return reduce(and_, [bits == mask for bits, mask in self._parts(name, start, count)])

    def on_any(self, name: str, start: date | str, count: int) -> Column:
        """The condition holds on some day of the window."""
        return reduce(or_, [bits != 0 for bits, _ in self._parts(name, start, count)])


def _for_each(bitmaps: Bitmaps, tests: Mapping[date, Column]) -> DataFrame:
    """serial_num and start: one row for each test that a home passes, in one pass over the bitmaps."""
    passed = [F.when(test, F.lit(day)) for day, test in tests.items()]
    if not passed:
        return bitmaps.table.select("serial_num", F.lit(None).cast("date").alias("start")).where("false")
    return bitmaps.table.select("serial_num", F.explode(F.array_compact(F.array(*passed))).alias("start"))


def row_count_bitmaps(
    homes: DataFrame, first: date | str, days: int, before: Column | None = None, after: Column | None = None
) -> Bitmaps:
    """Bitmaps `before` and `after` of conditions on the number of rows (`rows`) of a home and day.

    By default one row before and two after an extender was installed.
    """
    daily = homes.where(in_days(first, days)).groupBy("serial_num", "date").agg(F.count("*").alias("rows"))
    conditions = {"before": F.col("rows") == 1 if before is None else before, "after": F.col("rows") == 2 if after is None else after}
    return Bitmaps(presence(daily, first, days, conditions), first, days)


def cohorts_by_counts(bitmaps: Bitmaps, starts: Sequence[date | str], days_before: int = 7, days_after: int = 8) -> DataFrame:
    """serial_num and start: the homes of `cohort.cohort_by_counts` for each of many start days."""
    tests = {}
    for day in map(as_day, starts):
        earlier = bitmaps.on_all("before", day - timedelta(days_before), days_before)
        tests[day] = earlier & bitmaps.on_all("after", day, days_after)
    return _for_each(bitmaps, tests)


def flag_bitmaps(devices: DataFrame, first: date | str, days: int) -> Bitmaps:
    """Bitmaps `known` (a device row with an extender flag) and `on` (one whose flag is set)."""
    flag = F.array_max("Rou_Ext")
    rows = devices.select("serial_num", "date", flag.alias("flag")).where(F.col("flag").isNotNull())
    return Bitmaps(presence(rows, first, days, {"known": F.lit(True), "on": F.col("flag") == 1}), first, days)


def cohorts_by_flags(bitmaps: Bitmaps, installs: Sequence[date | str], count: int) -> DataFrame:
    """serial_num and start: the homes of `cohort.rolling_cohort` for each of many install days."""
    tests = {}
    for day in map(as_day, installs):
        earlier = day - timedelta(count)
        never = bitmaps.on_any("known", earlier, count) & ~bitmaps.on_any("on", earlier, count)
        tests[day] = never & bitmaps.on_any("on", day, count) & bitmaps.on_any("on", day + timedelta(count), count)
    return _for_each(bitmaps, tests)
