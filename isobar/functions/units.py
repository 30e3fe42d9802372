"""Units: a table of linear conversions to base units, and comparison."""

from __future__ import annotations

import re

from pyspark.sql import Column

from isobar.errors import UnitsError
from isobar.model import Field

# Unit, dimension, scale and offset to the dimension's base unit.
TABLE = {
    "k": ("temperature", 1.0, 0.0),
    "kelvin": ("temperature", 1.0, 0.0),
    "c": ("temperature", 1.0, 273.15),
    "celsius": ("temperature", 1.0, 273.15),
    "degc": ("temperature", 1.0, 273.15),
    "degree_celsius": ("temperature", 1.0, 273.15),
    "f": ("temperature", 5.0 / 9.0, 459.67 * 5.0 / 9.0),
    "fahrenheit": ("temperature", 5.0 / 9.0, 459.67 * 5.0 / 9.0),
    "degf": ("temperature", 5.0 / 9.0, 459.67 * 5.0 / 9.0),
    "m": ("length", 1.0, 0.0),
    "km": ("length", 1000.0, 0.0),
    "cm": ("length", 0.01, 0.0),
    "mm": ("length", 0.001, 0.0),
    "inch": ("length", 0.0254, 0.0),
    "foot": ("length", 0.3048, 0.0),
    "kg m-2 s-1": ("water", 1.0, 0.0),
    "mm/s": ("water", 1.0, 0.0),
    "mm/day": ("water", 1.0 / 86400.0, 0.0),
    "kg m-2 d-1": ("water", 1.0 / 86400.0, 0.0),
    "m s-1": ("speed", 1.0, 0.0),
    "m/s": ("speed", 1.0, 0.0),
    "km/h": ("speed", 1.0 / 3.6, 0.0),
    "knot": ("speed", 1852.0 / 3600.0, 0.0),
    "pa": ("pressure", 1.0, 0.0),
    "hpa": ("pressure", 100.0, 0.0),
    "mb": ("pressure", 100.0, 0.0),
    "kpa": ("pressure", 1000.0, 0.0),
    "1": ("ratio", 1.0, 0.0),
    "%": ("ratio", 0.01, 0.0),
    "percent": ("ratio", 0.01, 0.0),
    "s": ("time", 1.0, 0.0),
    "minute": ("time", 60.0, 0.0),
    "hour": ("time", 3600.0, 0.0),
    "day": ("time", 86400.0, 0.0),
}


def known(units: str | None) -> tuple[str, float, float] | None:
    return TABLE.get(re.sub(r"\s+", " ", units.strip().lower())) if units else None


def equal(a: str | None, b: str | None) -> bool:
    """Whether two units say the same, by the table or, outside it, by their text without regard to case."""
    x, y = known(a), known(b)
    return x == y if x and y else (a or "").strip().lower() == (b or "").strip().lower()


def convertible(a: str | None, b: str | None) -> bool:
    x, y = known(a), known(b)
    return bool(x and y and x[0] == y[0]) or equal(a, b)


def factors(source: str | None, target: str) -> tuple[float, float]:
    """scale and offset: target = source * scale + offset."""
    if not source:
        raise UnitsError("the source has no units")
    if equal(source, target):
        return 1.0, 0.0
    x, y = known(source), known(target)
    if not x or not y or x[0] != y[0]:
        raise UnitsError(f"{source} can't be converted to {target}")
    return x[1] / y[1], (x[2] - y[2]) / y[1]


def convert(col: Column, source: str, target: str) -> Column:
    scale, offset = factors(source, target)
    return col * scale + offset


def conform(f: Field, target: str | dict[str, str]) -> Field:
    """Data variables in other units, one for all or by variable."""
    wanted = target if isinstance(target, dict) else dict.fromkeys(f.variables, target)
    cols = {v: convert(f.df[v], f.units.get(v), u) for v, u in wanted.items()}
    return f.with_df(f.df.withColumns(cols), units={**f.units, **wanted})


def conform_axis(f: Field, axis: str, source: str, target: str) -> Field:
    """An axis and its bounds in other units."""
    names = [f.dims.column(axis), *(f.bounds(axis) or ())]
    return f.with_df(f.df.withColumns({c: convert(f.df[c], source, target) for c in names}))
