"""Numeric times in calendars that timestamps can't hold, by whole-number arithmetic on columns, and odd time units."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from isobar.errors import DefinitionError

#: Days before each month of a common and of a leap year.
COMMON = (0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334)
LEAP = tuple(d + (k > 1) for k, d in enumerate(COMMON))
PER = {"second": 86400.0, "minute": 1440.0, "hour": 24.0, "day": 1.0}
FIXED_YEARS = {"noleap": (365, COMMON), "365_day": (365, COMMON), "all_leap": (366, LEAP), "366_day": (366, LEAP)}


def origin(units: str) -> tuple[float, datetime]:
    """Units a day, and the origin, of units like "days since 2000-01-01"."""
    m = re.fullmatch(r"\s*(second|minute|hour|day)s?\s+since\s+(\d{1,4})-(\d{1,2})-(\d{1,2})(?:[ T](\d{1,2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?)?\s*Z?", units)
    if not m:
        raise DefinitionError(f"time units {units}")
    return PER[m[1]], datetime(int(m[2]), int(m[3]), int(m[4]), int(m[5] or 0), int(m[6] or 0), int(m[7] or 0))


def to_timestamp(value: Column, units: str) -> Column:
    """Numeric time of the standard calendar as a timestamp."""
    per, start = origin(units)
    seconds = F.round(value * (86400.0 / per)).cast("long")
    return F.timestamp_add("SECOND", seconds, F.lit(start.isoformat(sep=" ")).cast("timestamp_ntz"))


def to_number(time: Column, units: str) -> Column:
    per, start = origin(units)
    return F.timestamp_diff("SECOND", F.lit(start.isoformat(sep=" ")).cast("timestamp_ntz"), time).cast("double") * per / 86400.0


def day_number(year: int, month: int, day: int, calendar: str) -> int:
    if calendar == "360_day":
        return year * 360 + (month - 1) * 30 + day - 1
    length, starts = FIXED_YEARS[calendar]
    return year * length + starts[month - 1] + day - 1


def date_parts(value: Column, units: str, calendar: str) -> tuple[Column, Column, Column]:
    """Year, month and day of numeric time in noleap, all_leap, 360_day or the standard calendar."""
    if calendar in ("standard", "gregorian", "proleptic_gregorian"):
        t = to_timestamp(value, units)
        return F.year(t), F.month(t), F.dayofmonth(t)
    if calendar != "360_day" and calendar not in FIXED_YEARS:
        raise DefinitionError(f"calendar {calendar}")
    per, start = origin(units)
    shift = (start.hour * 3600 + start.minute * 60 + start.second) / 86400.0
    day = F.floor(value / per + shift).cast("long") + day_number(start.year, start.month, start.day, calendar)
    length = 360 if calendar == "360_day" else FIXED_YEARS[calendar][0]
    year, rest = F.floor(day / length).cast("int"), F.pmod(day, F.lit(length)).cast("int")
    if calendar == "360_day":
        return year, F.floor(rest / 30).cast("int") + 1, F.pmod(rest, F.lit(30)) + 1
    starts = FIXED_YEARS[calendar][1]
    month = sum((F.when(rest >= s, 1).otherwise(0) for s in starts[1:]), F.lit(1))
    first = F.greatest(*(F.when(rest >= s, F.lit(s)) for s in starts))
    return year, month, rest - first + 1


def months_since(value: Column, units: str) -> Column:
    """Time of "months since" units: the 16th of the month."""
    m = re.fullmatch(r"\s*months?\s+since\s+(\d{1,4})-(\d{1,2}).*", units)
    if not m:
        raise DefinitionError(f"time units {units}")
    months = F.floor(value).cast("long") + int(m[1]) * 12 + int(m[2]) - 1
    return F.make_timestamp_ntz(F.floor(months / 12).cast("int"), (F.pmod(months, F.lit(12)) + 1).cast("int"), F.lit(16), F.lit(0), F.lit(0), F.lit(0))


def template_days(value: Column) -> Column:
    """Time of "day as %Y%m%d.%f" units."""
    whole = F.floor(value).cast("long")
    date = F.to_timestamp_ntz(F.lpad(whole.cast("string"), 8, "0"), F.lit("yyyyMMdd"))
    return F.timestamp_add("SECOND", F.round((value - whole) * 86400).cast("long"), date)


def month_distance(low: Column, high: Column) -> Column:
    return (F.year(high) - F.year(low)) * 12 + F.month(high) - F.month(low)
