"""A request: datasets, subsets, selections, averaging, regridding, calculations and output, as one lazy plan."""

from __future__ import annotations

import ast
from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace
from datetime import datetime
from typing import Any
from urllib.parse import parse_qsl

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar import sinks
from isobar.errors import DefinitionError
from isobar.functions import crs as C
from isobar.functions import units as U
from isobar.model import Field, merge
from isobar.operators import filters, spatial
from isobar.operators import regrid as R
from isobar.operators.grouping import Grouping, keyed, stamped, summary
from isobar.plans.calculate import calculate, parse_calc
from isobar.sources.datasets import Dataset


@dataclass
class Request:
    """All parameters of a request; None or False leaves a step out."""

    dataset: Any
    spatial_operation: str = "intersects"
    geom: Any = None
    geom_select_sql_where: str | None = None
    geom_select_uid: list[int] | None = None
    geom_uid: str | None = None
    aggregate: bool = False
    calc: Any = None
    calc_grouping: Any = None
    calc_raw: bool = False
    calc_sample_size: bool = False
    abstraction: str = "auto"
    snippet: bool = False
    prefix: str = "isobar_output"
    output_format: str = "dataframe"
    output_format_options: dict[str, Any] = field(default_factory=dict)
    agg_selection: bool = False
    vector_wrap: bool = True
    allow_empty: bool = True
    dir_output: str = "."
    slice: Any = None
    file_only: bool = False
    format_time: bool = True
    search_radius_mult: float | None = None
    output_crs: C.Crs | None = None
    interpolate_spatial_bounds: bool = False
    add_auxiliary_files: bool = False
    optimized_bbox_subset: bool = False
    callback: Callable[[float, str], None] | None = None
    time_range: tuple[datetime, datetime] | None = None
    time_region: dict[str, list[int]] | None = None
    time_subset_func: Callable[..., Column] | None = None
    level_range: tuple[float, float] | None = None
    conform_units_to: str | dict[str, str] | None = None
    select_nearest: bool = False
    regrid_destination: Any = None
    regrid_options: dict[str, Any] = field(default_factory=dict)
    melted: bool = False
    spatial_wrapping: str | None = None
    spatial_reorder: bool = False
    keep_touches: bool | None = None
    multivariate: bool = False
    geom_crs: C.Crs | None = None

    @classmethod
    def from_query(cls, query: str, dataset: Any) -> Request:
        """From URL parameters of the same names; values are literals, ranges a|b, and parts month~6|7."""
        known, given = {f.name for f in fields(cls)}, {}
        for name, text in parse_qsl(query):
            if name not in known or name == "dataset":
                raise DefinitionError(f"unknown parameter {name}")
            if name == "time_range":
                given[name] = tuple(datetime.fromisoformat(x) for x in text.split("|"))
            elif name == "level_range":
                given[name] = tuple(float(x) for x in text.split("|"))
            elif name == "time_region":
                given[name] = {k: [int(x) for x in v.split("|")] for k, v in (p.split("~") for p in text.split(","))}
            elif name == "geom_select_uid":
                given[name] = [int(x) for x in text.split("|")]
            elif name == "calc":
                given[name] = text.split("|")
            elif name in ("geom", "geom_select_sql_where", "geom_uid", "spatial_operation", "output_format", "prefix", "abstraction", "conform_units_to", "spatial_wrapping", "dir_output"):
                given[name] = text
            elif name == "calc_grouping" and text == "all":
                given[name] = text
            elif name == "calc_grouping" and "[" not in text:
                given[name] = text.split("|")
            else:
                given[name] = ast.literal_eval({"true": "True", "false": "False"}.get(text.lower(), text))
        return cls(dataset, **given)

    def validate(self) -> None:
        """Parameters that contradict each other."""
        wrong = lambda test, text: (_ for _ in ()).throw(DefinitionError(text)) if test else None
        wrong(self.spatial_operation not in ("intersects", "clip"), f"spatial_operation {self.spatial_operation}")
        wrong(self.output_format != "dataframe" and self.output_format not in sinks.WRITERS, f"output_format {self.output_format}")
        wrong(self.snippet and self.calc, "snippet and calc exclude each other")
        wrong(self.slice is not None and self.snippet, "slice and snippet exclude each other")
        wrong(self.file_only and (self.output_format != "nc" or not self.calc), "file_only is for calculations in NetCDF")
        wrong(self.optimized_bbox_subset and self.spatial_operation == "clip", "optimized_bbox_subset is for intersects")
        wrong(self.spatial_reorder and self.aggregate, "spatial_reorder and aggregate exclude each other")
        wrong(isinstance(self.regrid_destination, list | tuple), "a request has one regrid_destination")
        wrong(self.regrid_destination is not None and self.spatial_operation == "clip", "a regridded field can't be clipped")
        wrong(self.output_format == "nc" and self.spatial_operation == "clip" and not self.aggregate, "NetCDF takes clipped fields only if averaged")
        wrong(self.output_format == "geojson" and self.output_crs is not None and not self.output_crs.geographic, "GeoJSON takes geographic coordinates")
        wrong(self.spatial_wrapping not in (None, "wrap", "unwrap"), f"spatial_wrapping {self.spatial_wrapping}")
        wrong(self.geom is None and (self.geom_select_uid or self.select_nearest), "a selection needs geom")
        for pair, name in ((self.time_range, "time_range"), (self.level_range, "level_range")):
            wrong(pair is not None and pair[0] > pair[1], f"{name}: the first is above the second")
        if self.time_range and self.time_region and self.time_region.get("year"):
            years = self.time_region["year"]
            wrong(max(years) < self.time_range[0].year or min(years) > self.time_range[1].year, "time_range and time_region don't overlap")
        if self.calc:
            calcs, grouping = parse_calc(self.calc), Grouping.parse(self.calc_grouping)
            wrong(grouping is not None and any(c["func"] is None for c in calcs), "expressions take no calc_grouping")
            wrong(self.output_format == "nc" and any(c["func"] == "freq_duration" for c in calcs), "freq_duration can't be written to NetCDF")

    def datasets(self) -> list[Any]:
        return list(self.dataset) if isinstance(self.dataset, list | tuple) else [self.dataset]

    def tell(self, share: float, text: str) -> None:
        if self.callback:
            self.callback(share, text)

    def fields_(self, spark: SparkSession) -> list[Field]:
        found = []
        for k, d in enumerate(self.datasets(), 1):
            f = d if isinstance(d, Field) else d.get(spark) if isinstance(d, Dataset) else Dataset(d).get(spark)
            found.append(replace(f, did=k))
        return [merge(found)] if self.multivariate and len(found) > 1 else found

    def subset(self, f: Field) -> Field:
        """Time, level and place filters, which reach the scan."""
        if self.time_range:
            f = filters.time_range(f, *self.time_range)
        if self.time_region:
            f = filters.time_region(f, self.time_region)
        if self.time_subset_func:
            f = filters.time_function(f, self.time_subset_func)
        if self.level_range:
            f = filters.level_range(f, *self.level_range)
        if self.slice is not None:
            f = filters.slice_axes(f, self.slice)
        return filters.snippet(f) if self.snippet else f

    def selection(self, spark: SparkSession) -> DataFrame | None:
        if self.geom is None or self.slice is not None:
            return None
        sel = spatial.selections(spark, self.geom)
        if self.geom_uid:
            sel = spatial.with_uid(sel.drop("ugid"), self.geom_uid)
        if self.geom_select_sql_where:
            sel = sel.where(self.geom_select_sql_where)
        return spatial.select_uid(sel, self.geom_select_uid) if self.geom_select_uid else sel

    def select(self, f: Field, sel: DataFrame | None) -> Field:
        if self.interpolate_spatial_bounds and not f.bounds("x"):
            f = spatial.with_bounds(spatial.with_bounds(f, "x"), "y")
        if self.abstraction == "point":
            f = f.drop_bounds("x", "y")
        if sel is None:
            return f
        # selections are geographic unless told otherwise, and go into the field's system
        sel = spatial.projected(sel, self.geom_crs or C.Crs(), f.dims.crs if isinstance(f.dims.crs, C.Crs) else self.geom_crs or C.Crs())
        if self.select_nearest:
            return spatial.nearest(f, sel, "gid")
        if self.search_radius_mult:
            step = spatial.resolution(f, "x").first()[0]
            return spatial.within_radius(f, sel, self.search_radius_mult * step)
        if self.agg_selection:
            return spatial.union_intersects(f, sel, self.keep_touches)
        if self.spatial_operation == "clip":
            return spatial.clip(f, sel)
        return spatial.intersects(f, sel, self.keep_touches, self.optimized_bbox_subset)

    def wrapped(self, f: Field) -> Field:
        if self.spatial_wrapping == "wrap":
            f = C.wrap(f)
        elif self.spatial_wrapping == "unwrap":
            f = C.unwrap(f)
        if self.output_crs is not None:
            f = C.transform(f, f.dims.crs if isinstance(f.dims.crs, C.Crs) else C.Crs(), self.output_crs)
        return spatial.reorder(f) if self.spatial_reorder else f

    def one(self, f: Field, sel: DataFrame | None) -> Field:
        f = self.select(self.subset(f), sel)
        if not self.allow_empty:
            filters.not_empty(f)
        if self.regrid_destination is not None:
            f = R.regrid(f, self.regrid_destination, **self.regrid_options)
        if self.aggregate and not (self.calc_raw and self.calc):
            f = spatial.weighted_average(f)
        f = self.wrapped(f)
        if self.conform_units_to:
            f = U.conform(f, self.conform_units_to)
        if self.calc:
            raw, f = f, calculate(f, self.calc, self.calc_grouping, self.calc_sample_size)
            if self.aggregate and self.calc_raw:
                f = self.averaged(raw, f)
        return f

    def averaged(self, raw: Field, f: Field) -> Field:
        """The average over cells of results that were made cell by cell. A group's time and bounds are those of its selection."""
        grouping = Grouping.parse(self.calc_grouping)
        if grouping is None:
            return spatial.weighted_average(f)
        times = ["time", "lb_time", "ub_time"]
        axes, bounds = ({k: v for k, v in x.items() if k != "time"} for x in (f.dims.axes, f.dims.bounds))
        mean = spatial.weighted_average(f.with_df(f.df.drop(*times), dims=type(f.dims)(axes, bounds, f.dims.crs)))
        on = [c for c in ("UGID", *grouping.names) if c in f.df.columns]
        stamps = stamped(keyed(raw.df, raw.axis("time"), grouping).groupBy(*on).agg(*summary(raw, grouping)), grouping)
        rows = mean.df.join(stamps, on) if on else mean.df.join(F.broadcast(stamps))  # without keys stamps is one row
        dims = type(f.dims)({**mean.dims.axes, "time": "time"}, {**mean.dims.bounds, "time": ("lb_time", "ub_time")}, f.dims.crs)
        return mean.with_df(rows, dims=dims)

    def plan(self, spark: SparkSession) -> list[Field]:
        """The result as fields, one for each dataset; nothing has run yet but small counts."""
        self.validate()
        sel = self.selection(spark)
        out = [self.one(f, sel) for f in self.fields_(spark)]
        self.tell(1.0, "planned")
        return out

    def execute(self, spark: SparkSession) -> Any:
        """A DataFrame, or the paths written."""
        made = self.plan(spark)
        if self.output_format == "dataframe":
            frames = [sinks.tabular(f, True) if self.melted else f.df.withColumn("DID", F.lit(f.did)) for f in made]
            out = frames[0]
            for df in frames[1:]:
                out = out.unionByName(df, allowMissingColumns=True)
            return out
        paths = []
        for f in made:
            suffix = {"nc": ".nc", "shp": ".shp", "meta-json": ".json", "meta-text": ".txt"}.get(self.output_format, "")
            path = f"{self.dir_output}/{self.prefix}" + (f"_{f.did}" if len(made) > 1 else "") + suffix
            if self.file_only:
                f = f.where(F.lit(False))
            sinks.write(f, self.output_format, path, **({"melted": True} if self.melted and self.output_format.startswith("csv") else {}), **self.output_format_options)
            paths.append(path)
        if self.add_auxiliary_files:
            sinks.did_table(spark, made, [str(getattr(d, "source", "")) for d in self.datasets()[: len(made)]]).write.csv(f"{self.dir_output}/{self.prefix}_did", header=True)
            with open(f"{self.dir_output}/{self.prefix}_metadata.txt", "w", encoding="utf-8") as out:
                out.write("\n".join(f"{x.name}={getattr(self, x.name)!r}" for x in fields(self)))
        return paths
