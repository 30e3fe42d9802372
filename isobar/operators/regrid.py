"""Regridding between rectilinear grids of longitudes and latitudes, by weights made axis by axis.

Along one axis each destination coordinate has its source coordinates and shares, found from the two axes' coordinate
tables; a cell's weight is the product. Conservative shares are areas on the sphere: spans of longitude times differences
of the sine of latitude. Fields are regridded along x, then along y, so no plan pairs the cells of two grids; a table of
all weights is made where it is asked for, to be kept or dealt out.

Both fields have to be geographic: fields in a projection are turned back first (functions.crs.transform). Masked values
(nulls) take no part; a cell without any value isn't in the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isobar.errors import RegridError
from isobar.functions.crs import Crs
from isobar.model import Field, mask


def axis_table(f: Field, axis: str) -> DataFrame:
    """(c, lb, ub) of the distinct coordinates of an axis."""
    c = f.dims.column(axis)
    pair = f.bounds(axis) or (c, c)
    return f.df.select(F.col(c).alias("c"), F.least(*pair).alias("lb") if pair[0] != pair[1] else F.col(c).alias("lb"), F.greatest(*pair).alias("ub") if pair[0] != pair[1] else F.col(c).alias("ub")).distinct()


def linear(source: DataFrame, dest: DataFrame, cyclic: float | None = None) -> DataFrame:
    """(s, d, w): each destination coordinate between two source ones, with shares by nearness."""
    pairs = source.select("c").withColumn("next", F.lead("c").over(W.orderBy("c")))
    if cyclic:
        ends = source.agg(F.min("c").alias("low"), F.max("c").alias("high"))
        pairs = pairs.where("next is not null").unionByName(ends.select(F.col("high").alias("c"), (F.col("low") + cyclic).alias("next")))
    d = dest.select(F.col("c").alias("d"))
    place = F.col("d") if not cyclic else F.when(F.col("d") < F.lit(source.agg(F.min("c")).first()[0]), F.col("d") + cyclic).otherwise(F.col("d"))
    last = pairs.agg(F.max(F.coalesce("next", "c")).alias("last")).first()[0]
    met = d.withColumn("p", place).join(pairs, (F.col("p") >= F.col("c")) & ((F.col("p") < F.col("next")) | ((F.col("p") == F.col("next")) & (F.col("next") == F.lit(last)))))
    t = (F.col("p") - F.col("c")) / (F.col("next") - F.col("c"))
    right = F.when(F.col("next") >= F.col("c"), F.col("next"))
    both = met.select("d", F.explode(F.array(F.struct(F.col("c").alias("s"), (1 - t).alias("w")), F.struct(right.alias("s"), t.alias("w")))).alias("e")).select("d", "e.s", "e.w").where("w > 0")
    if cyclic:
        both = both.withColumn("s", F.when(F.col("s") > F.lit(source.agg(F.max("c")).first()[0]), F.col("s") - cyclic).otherwise(F.col("s")))
    return both


def overlap(source: DataFrame, dest: DataFrame, latitudes: bool = False) -> DataFrame:
    """(s, d, w): lengths that source and destination intervals share; of latitudes the differences of their sines, in degrees."""
    a, b = source.select(F.col("c").alias("s"), "lb", "ub"), dest.select(F.col("c").alias("d"), F.col("lb").alias("dl"), F.col("ub").alias("du"))
    at = lambda c: F.degrees(F.sin(F.radians(F.least(F.greatest(c, F.lit(-90.0)), F.lit(90.0))))) if latitudes else c
    met = a.join(b, (F.col("lb") < F.col("du")) & (F.col("ub") > F.col("dl")))
    return met.select("s", "d", (at(F.least("ub", "du")) - at(F.greatest("lb", "dl"))).alias("w")).where("w > 0")


def nearest_axis(source: DataFrame, dest: DataFrame) -> DataFrame:
    """(s, d, w): the nearest source coordinate; of two, the larger."""
    s = source.select("c").withColumns({"prev": F.lag("c").over(W.orderBy("c")), "next": F.lead("c").over(W.orderBy("c"))})
    low, high = (F.col("c") + F.col("prev")) / 2, (F.col("c") + F.col("next")) / 2
    return dest.select(F.col("c").alias("d")).join(s, (F.col("prev").isNull() | (F.col("d") >= low)) & (F.col("next").isNull() | (F.col("d") < high))).select(F.col("c").alias("s"), "d", F.lit(1.0).alias("w"))


def method_for(source: Field, dest: Field) -> str:
    """Conservative if both have bounds, else bilinear."""
    return "conserve" if all(f.bounds(a) for f in (source, dest) for a in ("x", "y")) else "bilinear"


def checked(source: Field, dest: Field) -> None:
    """Both fields have to lie on the sphere."""
    for f in (source, dest):
        found = f.dims.crs
        system = found if isinstance(found, Crs) else Crs.from_cf(found) if found else Crs()
        if not system.geographic:
            raise RegridError(f"{f.name} is in {system.kind} coordinates: regridding takes geographic ones")


def axis_weights(source: Field, dest: Field, method: str = "auto", cyclic: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(s, d, w) of the x axes and of the y axes."""
    checked(source, dest)
    method = method_for(source, dest) if method == "auto" else method
    axes = []
    for axis in ("x", "y"):
        s, d = axis_table(source, axis), axis_table(dest, axis)
        if method == "conserve":
            if not source.bounds(axis) or not dest.bounds(axis):
                raise RegridError("conservative regridding needs bounds on both grids")
            axes.append(overlap(s, d, axis == "y"))
        elif method == "bilinear":
            axes.append(linear(s, d, cyclic if axis == "x" else None))
        elif method == "nearest":
            axes.append(nearest_axis(s, d))
        else:
            raise RegridError(f"no method {method}")
    return axes[0], axes[1]


def weights(source: Field, dest: Field, method: str = "auto", cyclic: float | None = None) -> DataFrame:
    """(sx, sy, dx, dy, w) of every pair of cells that share in each other."""
    x, y = (t.withColumnsRenamed({"s": f"s{a}", "d": f"d{a}", "w": f"w{a}"}) for t, a in zip(axis_weights(source, dest, method, cyclic), "xy", strict=True))
    return x.crossJoin(y).select("sx", "sy", "dx", "dy", (F.col("wx") * F.col("wy")).alias("w"))  # axes against axes: one row per weight


def apply_weights(f: Field, table: DataFrame, normalise: bool = True) -> Field:
    """Destination values: sums of weight times source value, by the weights of values that are there if normalise.

    Cells without any source value aren't in the result, which stands for masked.
    """
    x, y = f.dims.column("x"), f.dims.column("y")
    gone = {x, y, *(f.bounds("x") or ()), *(f.bounds("y") or ()), *f.variables}
    keys = [c for c in f.df.columns if c not in gone]
    met = f.df.select(*keys, F.col(x).alias("sx"), F.col(y).alias("sy"), *f.variables).join(table, ["sx", "sy"])

    def value(v: str) -> Column:
        total = F.sum(F.col("w") * F.col(v))
        return (total / F.sum(F.when(F.col(v).isNotNull(), F.col("w"))) if normalise else total).alias(v)

    out = met.groupBy(*keys, "dx", "dy").agg(*map(value, f.variables)).withColumnsRenamed({"dx": x, "dy": y})
    dims = type(f.dims)(f.dims.axes, {k: v for k, v in f.dims.bounds.items() if k not in ("x", "y")}, f.dims.crs)
    return f.with_df(out.dropna(how="all", subset=list(f.variables)), dims=dims)


def along(f: Field, axis: str, table: DataFrame) -> Field:
    """One axis in destination coordinates: of each variable the weighted sum, and in __of_ the weights of values that are there."""
    c = f.dims.column(axis)
    gone = {c, *(f.bounds(axis) or ()), *f.variables, *(f"__of_{v}" for v in f.variables)}
    keys = [k for k in f.df.columns if k not in gone]
    met = f.df.join(table.select(F.col("s").alias(c), F.col("d").alias("__d"), F.col("w").alias("__w")), c)
    there = lambda v: F.col(f"__of_{v}") if f"__of_{v}" in f.df.columns else F.when(F.col(v).isNotNull(), 1.0)
    sums = [x for v in f.variables for x in (F.sum(F.col("__w") * F.col(v)).alias(v), F.sum(F.col("__w") * there(v)).alias(f"__of_{v}"))]
    out = met.groupBy(*keys, "__d").agg(*sums).withColumnRenamed("__d", c)
    dims = type(f.dims)(f.dims.axes, {k: v for k, v in f.dims.bounds.items() if k != axis}, f.dims.crs)
    return f.with_df(out, dims=dims)


def regrid(source: Field, dest: Field, method: str = "auto", cyclic: float | None = None, value_mask: Column | None = None, weights_in: DataFrame | str | None = None, weights_out: str | None = None, allow_empty: bool = False) -> Field:
    """Source values on the destination's cells. value_mask: where it holds, values take no part.

    weights_out: a path for the table of all weights; weights_in: such a table, or its path, in place of making one. Without allow_empty, grids that don't meet are an error.
    """
    if value_mask is not None:
        source = mask(source, value_mask)
    if weights_in is not None:
        checked(source, dest)
        table = source.df.sparkSession.read.parquet(weights_in) if isinstance(weights_in, str) else weights_in
        return apply_weights(source, table)
    tables = axis_weights(source, dest, method, cyclic)
    if not allow_empty and any(t.isEmpty() for t in tables):
        raise RegridError("no destination cell meets a source cell")
    if weights_out:
        weights(source, dest, method, cyclic).write.parquet(weights_out)
    slim = source.with_df(source.df.drop(*(c for b in (source.bounds("x"), source.bounds("y")) for c in b or ())), dims=type(source.dims)(source.dims.axes, {k: v for k, v in source.dims.bounds.items() if k not in ("x", "y")}, source.dims.crs))
    done = along(along(slim, "x", tables[0]), "y", tables[1])
    values = [(F.col(v) / F.nullif(F.col(f"__of_{v}"), F.lit(0.0))).alias(v) for v in source.variables]
    kept = [c for c in done.df.columns if c not in source.variables and not c.startswith("__of_")]
    return done.with_df(done.df.select(*kept, *values).dropna(how="all", subset=list(source.variables)))


def chunked_weights(source: Field, dest: Field, tile: float, method: str = "auto") -> DataFrame:
    """Weights with the destination tile that each belongs to, to be written by tile and merged again."""
    return weights(source, dest, method).withColumns({"tile_x": F.floor(F.col("dx") / tile), "tile_y": F.floor(F.col("dy") / tile)})


def source_chunks(source: Field, tile: float, buffer: float) -> DataFrame:
    """Source cells with each destination tile that they lie in or within buffer of."""
    x, y = source.axis("x"), source.axis("y")
    span = lambda c: F.explode(F.sequence(F.floor((c - buffer) / tile), F.floor((c + buffer) / tile)))
    return source.df.withColumn("tile_x", span(x)).withColumn("tile_y", span(y))


def insert(master: Field, part: Field) -> Field:
    """A master field with the values of a part in the cells that it covers."""
    keys = [c for c in master.df.columns if c in part.df.columns and c not in master.variables]
    more = part.df.select(*keys, *(F.col(v).alias(f"__{v}") for v in master.variables))
    out = master.df.join(more, keys, "left").withColumns({v: F.coalesce(F.col(f"__{v}"), F.col(v)) for v in master.variables})
    return master.with_df(out.drop(*(f"__{v}" for v in master.variables)))
