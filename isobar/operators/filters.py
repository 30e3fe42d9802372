"""Filters on time, level, index and selection, as columns that reach the scan where they can."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isobar.errors import DefinitionError, EmptySubsetError
from isobar.model import Field

PARTS: dict[str, Callable[[Column], Column]] = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second}


def stamp(value: Any) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz") if isinstance(value, datetime) else F.lit(value)


def between(col: Column, low: Any, high: Any, exclusive: bool = False) -> Column:
    low, high = stamp(low), stamp(high)
    return (col > low) & (col < high) if exclusive else (col >= low) & (col <= high)


def bounds_between(lb: Column, ub: Column, low: Any, high: Any, exclusive: bool = False, contiguous: bool = True) -> Column:
    """Whether an interval meets a range. Of contiguous bounds, the upper one belongs to the next interval."""
    low, high = stamp(low), stamp(high)
    if exclusive:
        return ((lb > low) | (ub > low)) & ((lb < high) | (ub < high))
    if contiguous:
        return ((lb >= low) | (ub > low)) & ((lb <= high) | (ub < high))
    return ((lb >= low) | (ub >= low)) & ((lb <= high) | (ub <= high))


def is_contiguous(f: Field, axis: str) -> bool:
    """Whether the first two intervals of an axis share an edge."""
    lb, ub = f.bounds(axis)
    rows = f.df.select(lb, ub).distinct().orderBy(lb, ub).limit(2).collect()
    return len(rows) == 2 and rows[0][1] == rows[1][0]


def axis_range(f: Field, axis: str, low: Any, high: Any, exclusive: bool = False, contiguous: bool | None = None) -> Field:
    if f.bounds(axis):
        lb, ub = map(F.col, f.bounds(axis))
        touching = is_contiguous(f, axis) if contiguous is None else contiguous
        return f.where(bounds_between(lb, ub, low, high, exclusive, touching))
    return f.where(between(f.axis(axis), low, high, exclusive))


def time_range(f: Field, low: datetime, high: datetime, **more: Any) -> Field:
    if low > high:
        raise DefinitionError("time_range: the first date is after the last")
    return axis_range(f, "time", low, high, **more)


def level_range(f: Field, low: float, high: float, **more: Any) -> Field:
    if low > high:
        raise DefinitionError("level_range: the lower level is above the upper")
    return axis_range(f, "level", low, high, **more)


def region_test(f: Field, region: dict[str, list[int]]) -> Column:
    """All of the named date parts are among those listed. With bounds, an interval's parts count from its lower bound to below
    its upper one, over the turn of the year."""
    tests = []
    for part, listed in region.items():
        if part not in ("year", "month", "day"):
            raise DefinitionError(f"time_region: unknown part {part}")
        if listed is None:
            continue
        of = PARTS[part]
        if not f.bounds("time"):
            tests.append(of(f.axis("time")).isin(list(listed)))
            continue
        low, high = (of(F.col(c)) for c in f.bounds("time"))
        end = F.when(low > high, high + 12).otherwise(high)
        tests.append(reduce(lambda a, b: a | b, [F.when(low != high, (F.lit(p) >= low) & (F.lit(p) < end)).otherwise(low == p) for p in listed]))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def time_region(f: Field, region: dict[str, list[int]]) -> Field:
    return f.where(region_test(f, region))


def time_function(f: Field, function: Callable[[Column, tuple[Column, Column] | None], Column]) -> Field:
    """A user's test of times and bounds, as a column."""
    pair = f.bounds("time")
    return f.where(function(f.axis("time"), tuple(map(F.col, pair)) if pair else None))


AXES = ("realization", "time", "level", "y", "x")


def with_index(f: Field, axis: str, name: str) -> Field:
    """The place of each coordinate on its axis, from 0: the few distinct coordinates are ranked, not the rows."""
    col = f.dims.column(axis)
    places = f.df.select(col).distinct().withColumn(name, F.row_number().over(W.orderBy(col)) - 1)
    return f.with_df(f.df.join(places, col))


def slice_axes(f: Field, parts: list[Any] | dict[str, Any]) -> Field:
    """A single place, a count from the end (negative), a range, or None for all, on each of AXES or by axis name."""
    parts = dict(zip(AXES, parts, strict=True)) if isinstance(parts, list | tuple) else parts
    for axis, part in parts.items():
        if part is None or not f.has(axis):
            continue
        f = with_index(f, axis, "__place")
        place = F.col("__place")
        if isinstance(part, int) and part < 0:
            last = f.df.select(f.dims.column(axis)).distinct().count()
            test = place >= last + part
        elif isinstance(part, int):
            test = place == part
        else:
            test = (place >= part[0]) & (place < part[1])
        f = f.with_df(f.df.where(test).drop("__place"))
    return f


def snippet(f: Field) -> Field:
    """The first realization, time and level."""
    firsts = [f.dims.column(a) for a in ("realization", "time", "level") if f.has(a)]
    for c in firsts:
        f = f.with_df(f.df.join(f.df.agg(F.min(c).alias("__first")), F.col(c) == F.col("__first")).drop("__first"))
    return f


def not_empty(f: Field) -> Field:
    if f.df.isEmpty():
        raise EmptySubsetError("the subset has no rows")
    return f
