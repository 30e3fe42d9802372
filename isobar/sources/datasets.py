"""Datasets: where a field comes from and what of it. Formats are found by the path's suffix or named."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.errors import DefinitionError
from isobar.functions import units as U
from isobar.model import DimensionMap, Field, merge
from isobar.operators import filters
from isobar.operators.spatial import ring_area
from isobar.sources.netcdf import NetcdfSource
from isobar.sources.vector import read_shapefile

Reader = Callable[[SparkSession, list[str], dict[str, Any]], DataFrame]


def read_netcdf(spark: SparkSession, paths: list[str], options: dict[str, Any]) -> DataFrame:
    spark.dataSource.register(NetcdfSource)
    frames = [spark.read.format("isobar-netcdf").option("path", p).options(**options).load() for p in paths]
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def read_geojson(spark: SparkSession, paths: list[str], options: dict[str, Any]) -> DataFrame:
    """(gid, geom_type, ring, x, y, properties) of a feature collection's features. Polygons keep their parts and holes."""
    feature = "struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"
    df = spark.read.text(paths, wholetext=True).select(F.from_json("value", f"type string, features array<{feature}>").alias("c"))
    out = df.select(F.posexplode("c.features").alias("gid", "f")).select((F.col("gid") + 1).alias("gid"), F.col("f.geometry.type").alias("geom_type"), F.col("f.geometry.coordinates").alias("raw"), F.col("f.properties").alias("properties"))
    points = lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    # the first ring of a polygon runs one way, its holes the other; each part is closed and ended by a null
    closed = lambda r: F.when(r[0] == F.element_at(r, -1), r).otherwise(F.concat(r, F.slice(r, 1, 1)))
    turned = lambda r, k: F.when((ring_area(r) >= 0) == (k == 0), r).otherwise(F.reverse(r))
    ended = lambda r, k: F.concat(closed(turned(points(r), k)), F.array(F.lit(None)))
    joined = lambda rings: F.flatten(F.transform(rings, ended))
    one, many = F.from_json("raw", "array<array<array<double>>>"), F.from_json("raw", "array<array<array<array<double>>>>")
    ring = F.when((F.col("geom_type") == "Polygon") & (F.size(one) == 1), points(one[0])).when(F.col("geom_type") == "Polygon", joined(one)).when(F.col("geom_type") == "MultiPolygon", F.flatten(F.transform(many, joined)))
    point = F.from_json("raw", "array<double>")
    return out.withColumn("ring", ring).withColumn("x", F.when(F.col("geom_type") == "Point", point[0])).withColumn("y", F.when(F.col("geom_type") == "Point", point[1])).drop("raw")


@dataclass(frozen=True)
class Driver:
    key: str
    pattern: str
    read: Reader
    priority: int = 0


DRIVERS: list[Driver] = [
    Driver("parquet", r"\.parquet/?$", lambda s, p, o: s.read.options(**o).parquet(*p)),
    Driver("orc", r"\.orc/?$", lambda s, p, o: s.read.options(**o).orc(*p)),
    Driver("csv", r"\.csv/?$", lambda s, p, o: s.read.options(**{"header": True, **o}).csv(p)),
    Driver("json", r"\.(json|jsonl)$", lambda s, p, o: s.read.options(**o).json(p)),
    Driver("vector", r"\.geojson$", read_geojson, 1),
    Driver("shapefile", r"\.shp$", lambda s, p, o: read_shapefile(s, p[0])),
    Driver("netcdf", r"\.nc$", read_netcdf),
]


def driver_for(paths: list[str], key: str | None = None) -> Driver:
    """The named driver, or the one whose pattern fits; the highest priority decides between several."""
    fits = [d for d in DRIVERS if (d.key == key if key else all(re.search(d.pattern, p) for p in paths))]
    best = [d for d in fits if d.priority == max(x.priority for x in fits)]
    if len(best) != 1:
        raise DefinitionError(f"no single driver for {paths}: {[d.key for d in best]}")
    return best[0]


def resolved(path: str, folder: str | None = None) -> str:
    """A URL or a path that is there as it is, else the path in a folder (ISOBAR_DATA by default)."""
    folder = folder or os.environ.get("ISOBAR_DATA")
    if "://" in path or os.path.exists(path) or any(c in path for c in "*?{") or not folder:
        return path
    return os.path.join(folder, path)


@dataclass
class Dataset:
    """A request for a field. source: a path, several, or a DataFrame or Field."""

    source: Any
    variable: str | list[str] | None = None
    units: dict[str, str] | None = None
    time_range: tuple[datetime, datetime] | None = None
    time_region: dict[str, list[int]] | None = None
    time_subset_func: Callable[..., Column] | None = None
    level_range: tuple[float, float] | None = None
    conform_units_to: str | dict[str, str] | None = None
    rename_variable: list[str] | dict[str, str] | None = None
    predicate: Callable[[str], bool] | None = None
    dimension_map: DimensionMap | None = None
    field_name: str | None = None
    driver: str | None = None
    driver_kwargs: dict[str, Any] = field(default_factory=dict)
    columns: dict[str, str] | None = None
    crs: Any = None
    schema: str | None = None
    uid: int = 1

    def frame(self, spark: SparkSession) -> DataFrame:
        if isinstance(self.source, DataFrame):
            return self.source
        if self.schema is not None and not self.source:
            return spark.createDataFrame([], self.schema)  # metadata alone
        paths = [resolved(p) for p in ([self.source] if isinstance(self.source, str) else self.source)]
        return driver_for(paths, self.driver).read(spark, paths, self.driver_kwargs)

    def get(self, spark: SparkSession) -> Field:
        """The field, with the request's own subsets; all of it is a plan. columns: name of each column by an expression."""
        if isinstance(self.source, Field):
            f = self.source
        else:
            df = self.frame(spark)
            if self.columns:
                df = df.select(*(F.expr(e).alias(n) for n, e in self.columns.items()))
            wanted = [self.variable] if isinstance(self.variable, str) else self.variable
            f = Field.of(df, wanted, self.dimension_map, units=dict(self.units or {}), name=self.field_name or "field", did=self.uid)
        if self.predicate:
            f = f.select_variables(*(v for v in f.variables if self.predicate(v)))
        if self.rename_variable:
            names = self.rename_variable if isinstance(self.rename_variable, dict) else dict(zip(f.variables, self.rename_variable, strict=True))
            f = f.rename(names)
        if self.time_range:
            f = filters.time_range(f, *self.time_range)
        if self.time_region:
            f = filters.time_region(f, self.time_region)
        if self.time_subset_func:
            f = filters.time_function(f, self.time_subset_func)
        if self.level_range:
            f = filters.level_range(f, *self.level_range)
        return U.conform(f, self.conform_units_to) if self.conform_units_to else f

    def inspect(self, spark: SparkSession) -> str:
        return self.get(spark).describe()


def read_all(spark: SparkSession, datasets: list[Dataset]) -> Field:
    """Several datasets as one field of all their variables."""
    return merge([d.get(spark) for d in datasets])


def from_records(spark: SparkSession, records: list[dict], schema: str, uid: str | None = None) -> DataFrame:
    """Records as rows with an id from 1, or from a column."""
    df = spark.createDataFrame([{**r, "__n": k} for k, r in enumerate(records, 1)], f"{schema}, __n int")
    return df.withColumn("ugid", F.col(uid).cast("int") if uid else F.col("__n")).drop("__n")


def request_size(f: Field) -> DataFrame:
    """(variable, kb): rows times the width of each variable."""
    widths = {"double": 8, "bigint": 8, "float": 4, "int": 4, "smallint": 2, "tinyint": 1}
    kinds = dict(f.df.dtypes)
    counts = f.df.agg(F.count("*").alias("n"))
    pairs = F.array(*(F.struct(F.lit(v).alias("variable"), F.lit(float(widths.get(kinds[v], 8))).alias("w")) for v in f.variables))
    return counts.select("n", F.explode(pairs).alias("p")).select("p.variable", (F.col("n") * F.col("p.w") / 1024).alias("kb"))


def meta_json(f: Field) -> str:
    return json.dumps({"name": f.name, "variables": {v: {"units": f.units.get(v)} for v in f.variables}, "dimension_map": f.dims.as_dict(), "attributes": f.attrs}, default=str, sort_keys=True)
