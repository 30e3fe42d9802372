"""Calculations by key. Each is columns over a field; groups of them share one aggregation.

kind: set (an aggregate), scalar (a column per value), multi (a column of several variables), window (a column over time),
runs (an aggregate of runs of consecutive hits), field (a DataFrame of its own). Nulls are masked values and are left out.
Scalar and multi calculations with a temporal grouping are averaged in each group.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isobar.errors import DefinitionError, UnitsError
from isobar.functions import units as U
from isobar.model import Field


@dataclass(frozen=True)
class Calculation:
    key: str
    kind: str
    build: Callable[..., Any]
    params: dict[str, Callable] = field(default_factory=dict)
    required: tuple[str, ...] = ()
    variables: tuple[str, ...] = ()
    needs_units: dict[str, str] = field(default_factory=dict)
    units: str | None = ""
    spatial: str = "avg"
    long_name: str = ""

    def checked(self, given: dict[str, Any]) -> dict[str, Any]:
        """Parameters of the right kinds; unknown and missing ones are refused."""
        unknown = set(given) - set(self.params) - set(self.variables)
        lacking = (set(self.required) | set(self.variables)) - set(given)
        if unknown or lacking:
            raise DefinitionError(f"{self.key}: " + "; ".join([f"unknown {sorted(unknown)}"] * bool(unknown) + [f"needs {sorted(lacking)}"] * bool(lacking)))
        return {k: self.params[k](v) if k in self.params else v for k, v in given.items()}

    def check_units(self, f: Field, names: dict[str, str]) -> None:
        for v, want in self.needs_units.items():
            if not U.equal(f.units.get(names.get(v, v)), want):
                raise UnitsError(f"{self.key}: {v} has to be in {want}")


REGISTRY: dict[str, Calculation] = {}


def register(calculation: Calculation) -> Calculation:
    """Adds a calculation; users add their own the same way."""
    REGISTRY[calculation.key] = calculation
    return calculation


def lookup(key: str) -> Calculation:
    if key not in REGISTRY:
        raise DefinitionError(f"unknown calculation {key}")
    return REGISTRY[key]


def operation(name: str) -> Callable[[Column, Any], Column]:
    found = {"gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v}.get(name)
    if not found:
        raise DefinitionError(f"unknown operation {name}")
    return found


def count_if(test: Column) -> Column:
    return F.count_if(test)


def between_count(x: Column, lower: float, upper: float) -> Column:
    if lower > upper:
        raise DefinitionError("between: lower is above upper")
    return count_if(x.between(lower, upper))


def floats(v: Any) -> list[float]:
    return [float(x) for x in v]


for key, build, name in (
    ("mean", F.avg, "Mean"),
    ("min", F.min, "Min"),
    ("max", F.max, "Max"),
    ("median", F.median, "Median"),
    ("std", F.stddev_pop, "Standard Deviation"),
    ("sum", F.sum, "Sum"),
):
    register(Calculation(key, "set", build, spatial="sum" if key == "sum" else "avg", long_name=name))
register(Calculation("freq_perc", "set", lambda x, percentile: F.percentile(x, F.lit(percentile / 100)), {"percentile": float}, ("percentile",), long_name="Percentile"))
register(Calculation("between", "set", between_count, {"lower": float, "upper": float}, ("lower", "upper"), units="1"))
register(Calculation("threshold", "set", lambda x, threshold, operation: count_if(globals()["operation"](operation)(x, threshold)), {"threshold": float, "operation": str}, ("threshold", "operation"), units="1"))
register(Calculation("ln", "scalar", lambda x: F.when(x > 0, F.ln(x)), units=None))
register(Calculation("divide", "multi", lambda arr1, arr2: arr1 / F.nullif(arr2, F.lit(0)), variables=("arr1", "arr2"), units=None))


def heat_index(tas: Column, rhs: Column) -> Column:
    """Rothfusz's regression in degrees Fahrenheit and percent; null below 80 degrees or 40 percent."""
    # The regression's coefficients by powers of temperature and humidity.
    terms = {(0, 0): -42.379, (1, 0): 2.04901523, (0, 1): 10.14333127, (1, 1): -0.22475541, (2, 0): -6.83783e-3, (0, 2): -5.481717e-2, (2, 1): 1.22874e-3, (1, 2): 8.5282e-4, (2, 2): -1.99e-6}
    product = lambda c, i, j: reduce(lambda a, b: a * b, [F.lit(c), *[tas] * i, *[rhs] * j])
    total = reduce(lambda a, b: a + b, [product(c, i, j) for (i, j), c in terms.items()])
    return F.when((tas >= 80) & (rhs >= 40), total)


register(Calculation("heat_index", "multi", heat_index, variables=("tas", "rhs"), needs_units={"tas": "fahrenheit", "rhs": "percent"}, units=None, long_name="Heat Index"))


def over_time(f: Field) -> Any:
    return W.partitionBy(*f.keys).orderBy(f.axis("time"))


def moving_window(f: Field, v: str, k: int, operation: str, mode: str = "valid") -> Column:
    """An aggregate over k centred steps; at the edges over fewer (same) or null (valid)."""
    if k < 3 or k % 2 == 0:
        raise DefinitionError("moving_window: k has to be odd, and 3 at least")
    if mode not in ("same", "valid"):
        raise DefinitionError(f"moving_window: mode {mode}")
    h, x = k // 2, F.col(v)
    w = over_time(f).rowsBetween(-h, h)
    if operation == "median":  # an exact median takes no frame, so the frame's values are sorted
        values = F.sort_array(F.filter(F.collect_list(x).over(w), lambda y: y.isNotNull()))
        n = F.size(values)
        out = F.when(n > 0, (F.element_at(values, F.greatest(F.floor((n + 1) / 2), F.lit(1)).cast("int")) + F.element_at(values, F.greatest(F.floor(n / 2) + 1, F.lit(1)).cast("int"))) / 2)
    else:
        made = {"mean": F.avg, "min": F.min, "max": F.max, "var": F.var_pop, "std": F.stddev_pop}
        if operation not in made:
            raise DefinitionError(f"moving_window: operation {operation}")
        out = made[operation](x).over(w)
    return F.when(F.count(F.lit(1)).over(w) == k, out) if mode == "valid" else out


def convolve_1d(f: Field, v: str, kernel: list[float], mode: str = "same") -> Column:
    """Discrete convolution along time: same is centred with zeros beyond the edges, valid is left-aligned with a null tail."""
    if mode not in ("same", "valid"):
        raise DefinitionError(f"convolve_1d: mode {mode}")
    n, w = len(kernel), over_time(f)
    shift = (n - 1) // 2 if mode == "same" else n - 1  # the output at i is the full convolution at i + shift
    tap = lambda d: F.col(v) if d == 0 else F.lead(v, d).over(w) if d > 0 else F.lag(v, -d).over(w)
    total = reduce(lambda a, b: a + b, [F.lit(c) * F.coalesce(tap(shift - m), F.lit(0.0)) for m, c in enumerate(kernel)])
    if mode == "valid":
        total = F.when(F.count(F.lit(1)).over(w.rowsBetween(0, n - 1)) == n, total)
    return F.when(F.col(v).isNotNull(), total)


register(Calculation("moving_window", "window", moving_window, {"k": int, "operation": str, "mode": str}, ("k", "operation")))
register(Calculation("convolve_1d", "window", lambda f, variable, **p: convolve_1d(f, variable, p["v"], p.get("mode", "same")), {"v": floats, "mode": str}, ("v",)))

SUMMARIES = {"mean": F.avg, "median": F.median, "std": F.stddev_pop, "max": F.max, "min": F.min}


def duration(length: Column, summary: str = "mean") -> Column:
    """A summary of the lengths of runs. A lone run gives its length whatever the summary, as do runs of single steps."""
    if summary not in SUMMARIES:
        raise DefinitionError(f"duration: summary {summary}")
    lone = (F.count(length) == 1) | (F.max(length) == 1)
    return F.coalesce(F.when(lone, F.max(length).cast("double")).otherwise(SUMMARIES[summary](length).cast("double")), F.lit(0.0))


register(Calculation("duration", "runs", lambda length, summary="mean", **_: duration(length, summary), {"threshold": float, "operation": str, "summary": str}, ("threshold", "operation"), units="day"))
register(Calculation("freq_duration", "runs", None, {"threshold": float, "operation": str}, ("threshold", "operation"), units="day"))
register(Calculation("freezethaw", "frame", None, {"threshold": float}, long_name="Number of freeze-thaw events"))
register(Calculation("daily_perc", "frame", None, {"percentile": float, "window_width": int, "only_leap_years": bool}, ("percentile", "window_width")))

# Indices of daily values, by their public definitions. Temperatures in K, precipitation in mm/day, snow in cm.
ZERO = 273.15
for key, build in {
    "TG": F.avg,
    "TN": F.avg,
    "TX": F.avg,
    "TXx": F.max,
    "TXn": F.min,
    "TNx": F.max,
    "TNn": F.min,
    "SU": lambda x: count_if(x > ZERO + 25),
    "TR": lambda x: count_if(x > ZERO + 20),
    "FD": lambda x: count_if(x < ZERO),
    "ID": lambda x: count_if(x < ZERO),
    "HD17": lambda x: F.sum(F.when(x < ZERO + 17, ZERO + 17 - x).otherwise(F.when(x.isNotNull(), 0.0))),
    "GD4": lambda x: F.sum(F.when(x > ZERO + 4, x - (ZERO + 4)).otherwise(F.when(x.isNotNull(), 0.0))),
    "PRCPTOT": lambda x: F.coalesce(F.sum(F.when(x >= 1, x)), F.lit(0.0)),
    "RR1": lambda x: count_if(x >= 1),
    "SDII": lambda x: F.avg(F.when(x >= 1, x)),
    "R10mm": lambda x: count_if(x >= 10),
    "R20mm": lambda x: count_if(x >= 20),
    "RX1day": F.max,
    "SD": F.avg,
    "SD1": lambda x: count_if(x >= 1),
    "SD5cm": lambda x: count_if(x >= 5),
    "SD50cm": lambda x: count_if(x >= 50),
}.items():
    register(Calculation(key, "set", build))
register(Calculation("DTR", "multi", lambda tasmax, tasmin: tasmax - tasmin, variables=("tasmax", "tasmin")))
register(Calculation("ETR", "multiset", lambda tasmax, tasmin: F.max(tasmax) - F.min(tasmin), variables=("tasmax", "tasmin")))
for key, op, limit in (("CSU", "gt", ZERO + 25), ("CFD", "lt", ZERO), ("CWD", "gte", 1.0), ("CDD", "lt", 1.0)):
    register(Calculation(key, "runs", lambda length, **_: F.coalesce(F.max(length), F.lit(0)).cast("long"), units="day", required=(), params={}, needs_units={}, long_name=f"{op} {limit}"))
RUN_TESTS = {"CSU": ("gt", ZERO + 25), "CFD": ("lt", ZERO), "CWD": ("gte", 1.0), "CDD": ("lt", 1.0)}
for key in ("vDTR", "RX5day", "TG10p", "TX10p", "TN10p", "TG90p", "TX90p", "TN90p", "WSDI", "CSDI", "R75p", "R75pTOT", "R95p", "R95pTOT", "R99p", "R99pTOT"):
    register(Calculation(key, "frame", None, variables=("tasmax", "tasmin") if key == "vDTR" else ()))
