"""Temporal groups: date parts, all, seasons, and complete seasons that span years."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobar.errors import DefinitionError, IncompleteSeasonError
from isobar.model import Field
from isobar.operators.filters import PARTS

#: The day, month and hour that stand for a month, a year and a day.
MONTH_DAY, YEAR_MONTH, YEAR_DAY, DAY_HOUR = 16, 7, 1, 12


@dataclass(frozen=True)
class Grouping:
    """parts: of day, month, year; or seasons, with per_year or unique; or neither: all times are one group."""

    parts: tuple[str, ...] = ()
    seasons: tuple[tuple[int, ...], ...] = ()
    per_year: bool = False
    unique: bool = False

    @classmethod
    def parse(cls, value: str | list | tuple | Grouping | None) -> Grouping | None:
        if value is None or isinstance(value, Grouping):
            return value
        if value == "all":
            return cls()
        words = [x for x in value if isinstance(x, str)]
        seasons = [tuple(x) for x in value if not isinstance(x, str)]
        if not seasons:
            unknown = [x for x in words if x not in ("day", "month", "year")]
            if unknown or not words:
                raise DefinitionError(f"calc_grouping: unknown {unknown or value}")
            return cls(parts=tuple(p for p in ("year", "month", "day") if p in words))
        months = [m for s in seasons for m in s]
        if len(set(months)) != len(months):
            raise DefinitionError("calc_grouping: a month is in more than one season")
        if any(m not in range(1, 13) for m in months) or any(x not in ("year", "unique") for x in words):
            raise DefinitionError(f"calc_grouping: {value}")
        for s in seasons:
            ring = sorted(s)
            gaps = sum((b - a) % 12 != 1 for a, b in zip(ring, [*ring[1:], ring[0] + 12], strict=True))
            if "unique" in words and gaps > 1:
                raise IncompleteSeasonError(f"the months {s} don't follow each other")
        order = max if "unique" in words else min
        return cls(seasons=tuple(sorted(seasons, key=order)), per_year="year" in words, unique="unique" in words)

    @property
    def names(self) -> list[str]:
        if self.seasons:
            return ["season", *(["year"] if self.per_year or self.unique else [])]
        return list(self.parts)


def wraps(season: tuple[int, ...]) -> bool:
    return {12, 1} <= set(season)


def leading(season: tuple[int, ...]) -> list[int]:
    """The months of a season over the turn of the year that lie in the earlier year."""
    if not wraps(season):
        return []
    out, month = [], 12
    while month in season:
        out.append(month)
        month -= 1
    return out


def keyed(df: DataFrame, time: Column, grouping: Grouping) -> DataFrame:
    """df with the group's key columns; times in no season go."""
    if not grouping.seasons:
        return df.withColumns({p: PARTS[p](time) for p in grouping.parts})
    month = F.month(time)
    season = reduce(lambda c, x: c.when(month.isin(list(x[1])), x[0]), enumerate(grouping.seasons), F.when(F.lit(False), 0))
    df = df.withColumn("season", season).where(month.isin([m for s in grouping.seasons for m in s]))
    if grouping.per_year:
        return df.withColumn("year", F.year(time))
    if grouping.unique:
        early = sorted({m for s in grouping.seasons for m in leading(s)})
        return df.withColumn("year", F.year(time) + (F.when(month.isin(early), 1).otherwise(0) if early else F.lit(0)))
    return df


def summary(f: Field, grouping: Grouping) -> list[Column]:
    """Aggregates that a group's bounds and time are made of."""
    time = f.axis("time")
    pair = None if grouping.unique else f.bounds("time")
    out = [F.min(F.col(pair[0]) if pair else time).alias("lb_time"), F.max(F.col(pair[1]) if pair else time).alias("ub_time")]
    if grouping.unique:
        out.append(F.count_distinct(F.month(time)).alias("__months"))
    if grouping == Grouping():
        # the value in the middle of the distinct times: place int(n / 2 - 1)
        times = F.array_sort(F.collect_set(time))
        out.append(F.element_at(times, F.greatest(F.floor(F.size(times) / 2 - 1), F.lit(0)).cast("int") + 1).alias("__middle"))
    return out


def stamped(df: DataFrame, grouping: Grouping) -> DataFrame:
    """df, one row per group, with the group's time; seasons that lack months go."""
    at = lambda y, m, d, hour=0: F.make_timestamp_ntz(y, m, d, F.lit(hour), F.lit(0), F.lit(0))
    low, high, parts = F.col("lb_time"), F.col("ub_time"), set(grouping.parts)
    if grouping.unique:
        sizes = reduce(lambda c, x: c.when(F.col("season") == x[0], len(x[1])), enumerate(grouping.seasons), F.when(F.lit(False), 0))
        df = df.where(F.col("__months") == sizes).drop("__months")
    if grouping.seasons:
        middle = reduce(lambda c, x: c.when(F.col("season") == x[0], x[1][len(x[1]) // 2]), ((k, s) for k, s in enumerate(grouping.seasons) if wraps(s)), F.when(F.lit(False), 0))
        month = middle.otherwise(F.floor((F.month(low) + F.month(high)) / 2).cast("int"))
        time = at(F.floor((F.year(low) + F.year(high)) / 2).cast("int"), month, F.lit(MONTH_DAY))
    elif not parts:
        return df.withColumnRenamed("__middle", "time")
    else:
        year = F.col("year") if "year" in parts else F.year(low)
        month = F.col("month") if "month" in parts else F.lit(YEAR_MONTH) if "year" in parts else F.month(low)
        day = F.col("day") if "day" in parts else F.lit(MONTH_DAY if "month" in parts else YEAR_DAY)
        time = at(year, month, day, DAY_HOUR if "day" in parts else 0)
    return df.withColumn("time", time)
