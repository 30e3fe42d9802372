"""Fields: long-form DataFrames whose columns have the roles of axes, bounds and data variables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobar.errors import DimensionMapError

#: Names by which axes are found if nothing else tells.
AXIS_NAMES = {
    "realization": ("rlz", "realization", "ensemble", "member"),
    "time": ("time", "t", "date", "datetime"),
    "level": ("level", "lev", "lvl", "height", "z", "plev"),
    "y": ("y", "yc", "lat", "latitude", "row", "rlat"),
    "x": ("x", "xc", "lon", "longitude", "col", "column", "rlon"),
    "geom": ("geom", "geometry", "wkb"),
}
BOUNDED = ("time", "level", "y", "x")


@dataclass(frozen=True)
class DimensionMap:
    """Which column stands for each axis, and which two for its bounds."""

    axes: dict[str, str] = field(default_factory=dict)
    bounds: dict[str, tuple[str, str]] = field(default_factory=dict)
    crs: dict[str, Any] | None = None

    @classmethod
    def detect(cls, df: DataFrame, given: DimensionMap | None = None) -> DimensionMap:
        """Axes by the columns' axis attribute, then by name; bounds by the prefixes lb_ and ub_. What is given goes first."""
        axes = dict(given.axes) if given else {}
        bounds = dict(given.bounds) if given else {}
        marks = {f.metadata.get("axis", "").lower(): f.name for f in df.schema if f.metadata}
        short = {"realization": "r", "time": "t", "level": "z", "y": "y", "x": "x", "geom": "g"}
        lower = {c.lower(): c for c in df.columns}
        for axis, names in AXIS_NAMES.items():
            if axis not in axes:
                found = marks.get(short[axis]) or next((lower[n] for n in names if n in lower), None)
                if found:
                    axes[axis] = found
        for axis in BOUNDED:
            name = axes.get(axis, "").lower()
            if axis not in bounds and name and f"lb_{name}" in lower and f"ub_{name}" in lower:
                bounds[axis] = (lower[f"lb_{name}"], lower[f"ub_{name}"])
        return cls(axes, bounds, given.crs if given else None)

    def column(self, axis: str) -> str:
        if axis not in self.axes:
            raise DimensionMapError(f"no column for axis {axis}")
        return self.axes[axis]

    def as_dict(self) -> dict:
        return {"axes": dict(self.axes), "bounds": {k: list(v) for k, v in self.bounds.items()}, "crs": self.crs}


@dataclass(frozen=True)
class Field:
    """A DataFrame with the roles of its columns. Masked values are nulls; every other column is a key of a cell."""

    df: DataFrame
    dims: DimensionMap
    variables: tuple[str, ...]
    units: dict[str, str] = field(default_factory=dict)
    attrs: dict[str, Any] = field(default_factory=dict)
    name: str = "field"
    did: int = 1

    @classmethod
    def of(cls, df: DataFrame, variables: tuple[str, ...] | list[str] | None = None, dims: DimensionMap | None = None, **more: Any) -> Field:
        """A field of any DataFrame; its data variables are the numeric columns without another role, unless given."""
        found = DimensionMap.detect(df, dims)
        roles = {*found.axes.values(), *(c for pair in found.bounds.values() for c in pair)}
        numeric = ("double", "float", "bigint", "int", "smallint", "tinyint")
        names = tuple(variables) if variables else tuple(c for c, t in df.dtypes if c not in roles and c.lower() not in KEYS and (t in numeric or t.startswith("decimal")))
        return cls(df, found, names, **more)

    def axis(self, name: str) -> Column:
        return F.col(self.dims.column(name))

    def has(self, name: str) -> bool:
        return name in self.dims.axes

    def bounds(self, name: str) -> tuple[str, str] | None:
        return self.dims.bounds.get(name)

    @property
    def keys(self) -> list[str]:
        """Columns that tell cells apart: all but time, its bounds and the data."""
        other = {self.dims.axes.get("time"), *(self.bounds("time") or ()), *self.variables}
        return [c for c in self.df.columns if c not in other]

    def with_df(self, df: DataFrame, **more: Any) -> Field:
        return replace(self, df=df, **more)

    def transform(self, f: Callable[[DataFrame], DataFrame]) -> Field:
        return self.with_df(f(self.df))

    def where(self, test: Column | str) -> Field:
        return self.with_df(self.df.where(test))

    def select_variables(self, *names: str) -> Field:
        drop = [v for v in self.variables if v not in names]
        return self.with_df(self.df.drop(*drop), variables=tuple(names))

    def rename(self, names: dict[str, str]) -> Field:
        units = {names.get(k, k): v for k, v in self.units.items()}
        return self.with_df(self.df.withColumnsRenamed(names), variables=tuple(names.get(v, v) for v in self.variables), units=units)

    def drop_bounds(self, *axes: str) -> Field:
        kept = {k: v for k, v in self.dims.bounds.items() if k not in axes}
        gone = [c for k, v in self.dims.bounds.items() if k in axes for c in v]
        return self.with_df(self.df.drop(*gone), dims=replace(self.dims, bounds=kept))

    def describe(self) -> str:
        """A report of axes, variables and units, from metadata alone."""
        lines = [f"field {self.name}", *(f"axis {k}: {v}" for k, v in self.dims.axes.items()), *(f"bounds {k}: {', '.join(v)}" for k, v in self.dims.bounds.items())]
        kinds = dict(self.df.dtypes)
        lines += [f"variable {v}: {kinds[v]}, units {self.units.get(v)}" for v in self.variables]
        return "\n".join([*lines, *(f"attribute {k}: {v}" for k, v in self.attrs.items())])


#: Names of key columns in tabular output, lower case.
KEYS = ("ugid", "gid", "did", "rlz", "year", "month", "day", "season", "calc_key", "src_var", "variable")


def stack(fields: list[Field], dim: str | None = None, values: list | None = None) -> Field:
    """Fields one after the other; with dim, a column that tells them apart."""
    marked = [f.df.withColumn(dim, F.lit(v)) if dim else f.df for f, v in zip(fields, values or range(len(fields)), strict=True)]
    out = marked[0]
    for df in marked[1:]:
        out = out.unionByName(df)
    return fields[0].with_df(out)


def merge(fields: list[Field]) -> Field:
    """One field with the variables of all, on the axes that they share."""
    out = fields[0]
    for f in fields[1:]:
        on = [c for c in out.df.columns if c in f.df.columns and c not in out.variables and c not in f.variables]
        out = out.with_df(out.df.join(f.df.select(*on, *f.variables), on), variables=(*out.variables, *f.variables), units={**out.units, **f.units})
    return out


def mask(f: Field, test: Column, cascade: bool = True, variable: str | None = None) -> Field:
    """Values where test holds become nulls, in one variable or in all."""
    names = f.variables if cascade or variable is None else (variable,)
    return f.with_df(f.df.withColumns({v: F.when(~F.coalesce(test, F.lit(False)), F.col(v)) for v in names}))
