"""Column functions that read router telemetry text under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The row key is 4 characters, a separator, the serial and a 13-character suffix.
ROW_PREFIX = 4
SERIAL_START = 6
SUFFIX = 13
SHORT_SERIAL_CUT = 4
UNIT = "Mbps"


def lenient_long(value: Column) -> Column:
    """Text to long: a fraction is cut off, anything that is not a number is NULL.

    The pattern decides before the cast, because a failing cast costs far more than a match.
    """
    whole = F.substring_index(value, ".", 1).try_cast("bigint")
    return F.when(value.rlike(r"^\s*[+-]?\d+(\.\d*)?\s*$"), whole)


def row_prefix(rowkey: Column) -> Column:
    return F.substring(rowkey, 1, ROW_PREFIX)


def serial_number(rowkey: Column) -> Column:
    """Serial part of a row key; '' when the key is too short to hold one."""
    return rowkey.substr(F.lit(SERIAL_START), F.length(rowkey) - F.lit(SERIAL_START - 1 + SUFFIX))


def short_serial(rowkey: Column) -> Column:
    cut = SERIAL_START - 1 + SUFFIX + SHORT_SERIAL_CUT
    return rowkey.substr(F.lit(SERIAL_START), F.length(rowkey) - F.lit(cut))


def group_key(rowkey: Column) -> Column:
    """Key under which the device-groups table stores this row's home."""
    return F.concat_ws("-", row_prefix(rowkey), serial_number(rowkey))


def strip_unit(rate: Column) -> Column:
    """Drop the last four characters, whatever they are, and read the rest as a long."""
    return lenient_long(rate.substr(F.lit(1), F.length(rate) - F.lit(len(UNIT))))


def remove_unit(rate: Column) -> Column:
    """Drop the unit name wherever it stands and read the rest as a long."""
    return lenient_long(F.replace(rate, F.lit(UNIT), F.lit("")))


def band(connect_type: Column) -> Column:
    return F.substring(connect_type, 1, 2)


def epoch_ms(ts: Column, to_seconds: bool = True) -> Column:
    """Epoch milliseconds to timestamp, cut to whole seconds unless asked otherwise."""
    moment = F.timestamp_millis(ts)
    return F.date_trunc("second", moment) if to_seconds else moment
