"""Selections and spatial predicates. Boxes are four columns; polygons are rings, arrays of points, in pure column math.

A ring without nulls is closed by its last side. Polygons of several parts or with holes are one array too: each part is
closed by its first point again and ended by a null; holes run against the direction of what they lie in.

A field's distinct cells, which are few against its rows, meet the selections by tile, an equi-join on a grid as wide as
the selections and cells are; the rows then meet their cell's selections by its coordinates. So no plan compares rows
with selections, and selections needn't be few.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isobar.errors import DefinitionError
from isobar.functions.crs import Crs, point
from isobar.model import Field

#: What is left out of results: the shapes of selections.
SHAPE = ("x0", "y0", "x1", "y1", "ring", "reach", "properties")
RING = "array<struct<x:double,y:double>>"
Box = tuple[float, float, float, float]


def selections(spark: SparkSession, geoms: Any, uid: str = "UGID") -> DataFrame:
    """(ugid, x0, y0, x1, y1, ring, properties...) from a DataFrame, boxes, points, rings, lists of rings, dicts with a geom, or text a|b|c|d."""
    if isinstance(geoms, DataFrame):
        return geoms if "ugid" in [c.lower() for c in geoms.columns] else with_uid(geoms)
    if isinstance(geoms, str):
        geoms = [tuple(float(x) for x in geoms.split("|"))]
    if geoms and isinstance(geoms, Sequence) and isinstance(geoms[0], int | float):
        geoms = [tuple(geoms)]
    rows = []
    for k, g in enumerate(geoms, 1):
        props = dict(g.get("properties", {})) if isinstance(g, dict) else {}
        shape = g["geom"] if isinstance(g, dict) else g
        if isinstance(shape[0], int | float):
            if len(shape) == 2:
                shape, ring = (shape[0], shape[1], shape[0], shape[1]), None
            elif len(shape) == 4:
                ring = None
            else:
                raise DefinitionError("a geometry is a point, a box or a ring")
            box = tuple(map(float, shape))
        else:
            several = shape if not isinstance(shape[0][0], int | float) else [shape]  # parts and holes, or one ring
            ring = together([[(float(a), float(b)) for a, b in r] for r in several])
            own = [p for p in ring if p]
            box = (min(a for a, _ in own), min(b for _, b in own), max(a for a, _ in own), max(b for _, b in own))
        rows.append((int(props.pop(uid, k)), *box, ring, {a: str(b) for a, b in props.items()}))
    return spark.createDataFrame(rows, f"ugid int, x0 double, y0 double, x1 double, y1 double, ring {RING}, properties map<string,string>")


def with_uid(df: DataFrame, uid: str | None = None) -> DataFrame:
    """df with an id from 1, from a column if there is one: selection tables are small enough to be numbered in order."""
    if uid and uid in df.columns:
        return df.withColumn("ugid", F.col(uid).cast("int"))
    return df.withColumn("ugid", F.row_number().over(W.orderBy(F.monotonically_increasing_id())))


def select_uid(sel: DataFrame, ids: Sequence[int]) -> DataFrame:
    return sel.where(F.col("ugid").isin(list(ids)))


def edges(f: Field) -> tuple[Column, Column, Column, Column]:
    """Columns of a cell's box: its bounds, or its point twice."""
    (xa, xb), (ya, yb) = (tuple(map(F.col, f.bounds(a) or (f.dims.column(a),) * 2)) for a in ("x", "y"))
    return F.least(xa, xb), F.least(ya, yb), F.greatest(xa, xb), F.greatest(ya, yb)


def overlaps(f: Field, touch: bool) -> Column:
    """Whether a cell's box meets the selection's box; touch: whether a common edge is enough."""
    x0, y0, x1, y1 = edges(f)
    if touch:
        return (x0 <= F.col("x1")) & (x1 >= F.col("x0")) & (y0 <= F.col("y1")) & (y1 >= F.col("y0"))
    return (x0 < F.col("x1")) & (x1 > F.col("x0")) & (y0 < F.col("y1")) & (y1 > F.col("y0"))


def sides(ring: Column) -> Column:
    """A ring's sides as pairs of points a and b; beside a null no side."""
    return F.arrays_zip(ring.alias("a"), F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)).alias("b"))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies in a ring, by the parity of crossings of the ray to its right."""
    crosses = lambda s: ((s.a.y > y) != (s.b.y > y)) & (x < (s.b.x - s.a.x) * (y - s.a.y) / F.nullif(s.b.y - s.a.y, F.lit(0.0)) + s.a.x)
    return F.size(F.filter(sides(ring), lambda s: F.coalesce(crosses(s), F.lit(False)))) % 2 == 1


def ring_meets_box(ring: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether a ring and a box share area: a side passes through the box's inside, or else the box lies in the ring as its centre does."""

    def cut(s: Column) -> Column:
        """Whether a side of the ring passes through the box's inside (slab test)."""
        dx, dy = F.nullif(s.b.x - s.a.x, F.lit(0.0)), F.nullif(s.b.y - s.a.y, F.lit(0.0))
        tx0, tx1, ty0, ty1 = (x0 - s.a.x) / dx, (x1 - s.a.x) / dx, (y0 - s.a.y) / dy, (y1 - s.a.y) / dy
        low = F.greatest(F.coalesce(F.least(tx0, tx1), F.lit(0.0)), F.coalesce(F.least(ty0, ty1), F.lit(0.0)), F.lit(0.0))
        high = F.least(F.coalesce(F.greatest(tx0, tx1), F.lit(1.0)), F.coalesce(F.greatest(ty0, ty1), F.lit(1.0)), F.lit(1.0))
        level = (dx.isNotNull() | ((s.a.x > x0) & (s.a.x < x1))) & (dy.isNotNull() | ((s.a.y > y0) & (s.a.y < y1)))
        return s.a.isNotNull() & s.b.isNotNull() & level & (low < high)

    return in_ring((x0 + x1) / 2, (y0 + y1) / 2, ring) | F.exists(sides(ring), lambda s: F.coalesce(cut(s), F.lit(False)))


def side_distance(s: Column, x: Column, y: Column) -> Column:
    """Square of a point's distance from a side."""
    dx, dy = s.b.x - s.a.x, s.b.y - s.a.y
    t = F.coalesce(((x - s.a.x) * dx + (y - s.a.y) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    ex, ey = s.a.x + t * dx - x, s.a.y + t * dy - y
    return ex * ex + ey * ey


def ring_distance(ring: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Square of the distance of a ring's line from a box, or a point, that no side passes through."""

    def one(s: Column) -> Column:
        ex, ey = (F.greatest(a - p, F.lit(0.0), p - b) for a, p, b in ((x0, s.a.x, x1), (y0, s.a.y, y1)))
        corner = [side_distance(s, x, y) for x in (x0, x1) for y in (y0, y1)]
        return F.when(s.a.isNotNull(), F.least(ex * ex + ey * ey, *corner))

    return F.array_min(F.transform(sides(ring), one))


def meets(f: Field, sel: DataFrame, touch: bool | None = None) -> Column:
    """Whether a cell meets a selection. Points keep touches, cells with area drop them, unless told otherwise."""
    polygons = bool(f.bounds("x") and f.bounds("y"))
    test = overlaps(f, not polygons if touch is None else touch)
    if "ring" not in sel.columns:
        return test
    exact = ring_meets_box(F.col("ring"), *edges(f)) if polygons else in_ring(f.axis("x"), f.axis("y"), F.col("ring"))
    if "reach" in sel.columns:
        far, reach = ring_distance(F.col("ring"), *edges(f)), F.col("reach") * F.col("reach")
        exact = exact | F.coalesce(far < reach if polygons and not touch else far <= reach, F.lit(False))
    return test & (F.col("ring").isNull() | exact)


def places(f: Field) -> list[str]:
    """Columns that say where a cell is."""
    return list(dict.fromkeys(c for a in ("x", "y") for c in (f.dims.column(a), *(f.bounds(a) or ()))))


def met_cells(f: Field, sel: DataFrame, test: Column, tile: float | None = None) -> DataFrame:
    """Distinct cells with the selections for which test holds."""
    areas = sel.select(*(c for c in sel.columns if c not in f.df.columns))
    cells = f.df.select(*places(f)).distinct()
    x0, y0, x1, y1 = edges(f)
    if tile:
        cells, areas = cells.withColumn("__tile", F.lit(tile)), areas.withColumn("__tile", F.lit(tile))
    else:
        side = lambda a, b, c, d: F.coalesce(F.greatest(c - a, d - b), F.lit(0.0))
        own, asked = side(x0, y0, x1, y1), side(*map(F.col, SHAPE[:4]))
        spread = sel.agg(F.greatest(F.avg(asked), F.max(asked) / 64, (F.max("x1") - F.min("x0")) / F.sqrt(F.count("*")) / 8))
        # as wide as selections and cells are on average, so that each lies in few tiles
        size = F.coalesce(F.nullif(F.greatest(cells.agg(F.greatest(F.avg(own), F.max(own) / 64)).scalar(), spread.scalar()), F.lit(0.0)), F.lit(1.0))
        cells, areas = cells.withColumn("__tile", size), areas.withColumn("__tile", size)
    at = lambda c: F.floor(c / F.col("__tile"))
    span = lambda a, b: F.explode(F.sequence(at(a), at(b)))
    cells = cells.withColumn("__tx", span(x0, x1)).withColumn("__ty", span(y0, y1))
    areas = areas.withColumn("__tx", span(F.col("x0"), F.col("x1"))).withColumn("__ty", span(F.col("y0"), F.col("y1"))).drop("__tile")
    # a pair shares several tiles: it counts in the first of them
    first = (F.col("__tx") == F.greatest(at(x0), at(F.col("x0")))) & (F.col("__ty") == F.greatest(at(y0), at(F.col("y0"))))
    return cells.join(areas, ["__tx", "__ty"]).where(first & test).drop("__tx", "__ty", "__tile")


def meeting(f: Field, pairs: DataFrame) -> DataFrame:
    """The rows of a field with what met_cells() found for their cells."""
    keys = places(f)
    return f.df.join(pairs.drop("ring", "reach", "properties"), keys).select(*f.df.columns, *(c for c in pairs.columns if c not in keys and c not in SHAPE[4:]))


def intersects(f: Field, sel: DataFrame, touch: bool | None = None, optimized: bool = False, tile: float | None = None) -> Field:
    """Cells that meet each selection, with its ugid. Points keep touches, cells with area drop them, unless told otherwise."""
    x, y = f.axis("x"), f.axis("y")
    test = x.between(F.col("x0"), F.col("x1")) & y.between(F.col("y0"), F.col("y1")) if optimized else meets(f, sel, touch)
    return f.with_df(meeting(f, met_cells(f, sel, test, tile)).drop(*SHAPE).withColumnRenamed("ugid", "UGID"))


def union_intersects(f: Field, sel: DataFrame, touch: bool | None = None, tile: float | None = None) -> Field:
    """Cells that meet any selection, once each, with ugid 1."""
    met = met_cells(f, sel, meets(f, sel, touch), tile).select(*places(f)).distinct()
    return f.with_df(f.df.join(met, places(f), "left_semi").select(*f.df.columns, F.lit(1).alias("UGID")))


def clip(f: Field, sel: DataFrame) -> Field:
    """Cells cut to each selection: boxes by their edges, rings by cutting the ring to the cell. __area is what is left.

    Each distinct cell is cut once for each selection. Grown rings have no cut form and raise an error.
    """
    names = [f.dims.column("x"), f.dims.column("y")]
    x0, y0, x1, y1 = edges(f)
    cut = [F.greatest(x0, F.col("x0")), F.greatest(y0, F.col("y0")), F.least(x1, F.col("x1")), F.least(y1, F.col("y1"))]
    area = (cut[2] - cut[0]) * (cut[3] - cut[1])
    (xa, xb), (ya, yb) = f.bounds("x"), f.bounds("y")
    if "ring" in sel.columns:
        ring = ring_area_in_box(F.col("ring"), x0, y0, x1, y1)
        if "reach" in sel.columns:
            ring = F.when(F.col("reach").isNull(), ring).otherwise(F.raise_error(F.lit("a grown ring can't be clipped")).cast("double"))
        area = F.when(F.col("ring").isNull(), area).otherwise(ring)
    pairs = met_cells(f, sel, overlaps(f, False)).withColumn("__area", area).where("__area > 0")
    out = meeting(f, pairs).withColumns({"__x0": cut[0], "__y0": cut[1], "__x1": cut[2], "__y1": cut[3]})
    out = out.withColumns({xa: F.col("__x0"), xb: F.col("__x1"), ya: F.col("__y0"), yb: F.col("__y1"), names[0]: (F.col("__x0") + F.col("__x1")) / 2, names[1]: (F.col("__y0") + F.col("__y1")) / 2})
    return f.with_df(out.drop("__x0", "__y0", "__x1", "__y1", *SHAPE).withColumnRenamed("ugid", "UGID"))


def parts(ring: list[tuple[float, float] | None]) -> list[list[tuple[float, float]]]:
    """The parts of a ring that nulls end."""
    out: list[list[tuple[float, float]]] = [[]]
    for p in ring:
        if p is None:
            out.append([])
        else:
            out[-1].append(p)
    return [x for x in out if x]


def together(rings: list[list[tuple[float, float]]]) -> list[tuple[float, float] | None]:
    """One ring of several parts, each closed and ended by a null; a lone part as it is."""
    if len(rings) == 1:
        return rings[0]
    return [p for r in rings for p in (*r, *(() if r[0] == r[-1] else (r[0],)), None)]


def cut_ring(ring: list[tuple[float, float]], box: Box) -> list[tuple[float, float]]:
    """A ring cut to a box, one side after the other."""
    for axis, limit, sign in ((0, box[0], 1), (1, box[1], 1), (0, box[2], -1), (1, box[3], -1)):
        out = []
        for a, b in zip(ring, [*ring[1:], ring[0]] if ring else [], strict=True):
            ina, inb = sign * (a[axis] - limit) >= 0, sign * (b[axis] - limit) >= 0
            if ina:
                out.append(a)
            if ina != inb:
                t = (limit - a[axis]) / (b[axis] - a[axis])
                out.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
        ring = out
    return ring


def signed_area(ring: list[tuple[float, float]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], ring[0]] if ring else [], strict=True)) / 2


def area_of(ring: list[tuple[float, float]]) -> float:
    return abs(signed_area(ring))


def ring_area_in_box(ring: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Area of a ring inside a box: clipping has no column form, so Arrow batches of pairs that already meet are cut."""

    @F.pandas_udf("double")
    def cut(rings: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        own = [None if r is None else parts([p and (p["x"], p["y"]) for p in r]) for r in rings]
        return pd.Series([None if r is None else abs(sum(signed_area(cut_ring(p, box)) for p in r)) for r, box in zip(own, zip(a, b, c, d, strict=True), strict=True)], dtype=float)

    return cut(ring, x0, y0, x1, y1)


def ring_area(ring: Column) -> Column:
    """Signed area, positive for rings that go counter-clockwise."""
    return F.aggregate(sides(ring), F.lit(0.0), lambda t, s: t + F.coalesce(s.a.x * s.b.y - s.b.x * s.a.y, F.lit(0.0))) / 2


def counter_clockwise(ring: Column) -> Column:
    return F.when(ring_area(ring) < 0, F.reverse(ring)).otherwise(ring)


def nearest(f: Field, sel: DataFrame, order: str, tile: float | None = None) -> Field:
    """For each selection the cell nearest to its centre; of equally near ones, that with the largest order column.

    The search goes outwards by tiles: cells within a reach are found by equi-join, a cell no farther than the reach is the
    nearest, and selections without one go on with twice the reach, until it spans all. Selections without a centre get none.
    """
    x, y = f.dims.column("x"), f.dims.column("y")
    middle = ((F.col("x0") + F.col("x1")) / 2).alias("__cx"), ((F.col("y0") + F.col("y1")) / 2).alias("__cy")
    cells = f.df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("__x"), F.col(y).alias("__y")).agg(F.max(order).alias(order))
    left = sel.select("ugid", *middle).where("__cx is not null and __cy is not null")
    span = lambda df, a, b: df.agg(F.count("*"), F.min(a), F.min(b), F.max(a), F.max(b)).first()
    (n, *own), (m, *asked) = span(cells, "__x", "__y"), span(left, "__cx", "__cy")
    d = (F.col("__x") - F.col("__cx")) * (F.col("__x") - F.col("__cx")) + (F.col("__y") - F.col("__cy")) * (F.col("__y") - F.col("__cy"))
    pick = lambda pairs: pairs.groupBy("ugid").agg(F.min_by(F.struct(order), F.struct(d, -F.col(order))).alias("best"), F.min(d).alias("__d2"))
    best = pick(cells.join(left, F.lit(False)))
    if n and m:
        # a little more than the distance of any cell from any centre; the first reach holds a few cells
        whole = 1.001 * sum(max(p, q) - min(a, b) for a, b, p, q in zip(own[:2], asked[:2], own[2:], asked[2:], strict=True)) + 1e-9
        reach = tile or max(((own[2] - own[0]) * (own[3] - own[1]) / n) ** 0.5, whole / 4096)
        kept = lambda df: df.checkpoint() if f.df.sparkSession.sparkContext.getCheckpointDir() else df
        while True:
            around = lambda c, r: F.explode(F.sequence(F.floor((c - r) / r), F.floor((c + r) / r)))
            wide = left.withColumn("__tx", around(F.col("__cx"), F.lit(reach))).withColumn("__ty", around(F.col("__cy"), F.lit(reach)))
            near = cells.withColumn("__tx", F.floor(F.col("__x") / reach)).withColumn("__ty", F.floor(F.col("__y") / reach))
            found = kept(pick(wide.join(near, ["__tx", "__ty"])).where(F.col("__d2") <= reach * reach))
            best = best.unionByName(found)
            left = kept(left.join(found.select("ugid"), "ugid", "left_anti"))
            if reach >= whole or left.isEmpty():
                break
            reach *= 2
    answer = best.select(F.col("ugid").alias("UGID"), F.col(f"best.{order}").alias("__order"), "__d2")
    return f.with_df(f.df.join(answer, F.col(order) == F.col("__order")).drop("__order"))


def within_radius(f: Field, sel: DataFrame, radius: float) -> Field:
    """Points within a radius of each selected point."""
    dx, dy = f.axis("x") - F.col("__px"), f.axis("y") - F.col("__py")
    grown = sel.select("ugid", F.col("x0").alias("__px"), F.col("y0").alias("__py"), *((F.col(c) + by).alias(c) for c, by in zip(SHAPE[:4], (-radius, -radius, radius, radius), strict=True)))
    met = meeting(f, met_cells(f, grown, dx * dx + dy * dy <= radius * radius))
    return f.with_df(met.drop("__px", "__py", *SHAPE).withColumnRenamed("ugid", "UGID"))


def buffered(sel: DataFrame, by: float) -> DataFrame:
    """Selections grown on all sides: boxes with square corners, rings by all that lies within reach of them."""
    out = sel.withColumns({"x0": F.col("x0") - by, "y0": F.col("y0") - by, "x1": F.col("x1") + by, "y1": F.col("y1") + by})
    if "ring" not in sel.columns:
        return out
    before = F.coalesce("reach", F.lit(0.0)) if "reach" in sel.columns else F.lit(0.0)
    return out.withColumn("reach", F.when(F.col("ring").isNotNull(), before + by))


def projected(sel: DataFrame, source: Crs, target: Crs) -> DataFrame:
    """Selections in another system, vertex by vertex: boxes become rings of their corners, points stay points."""
    if source.matches(target) or (source.geographic and target.geographic):
        return sel
    ring = F.col("ring") if "ring" in sel.columns else F.lit(None).cast(RING)
    lone = ring.isNull() & (F.col("x0") == F.col("x1")) & (F.col("y0") == F.col("y1"))
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    box = F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"))

    def moved(p: Column) -> Column:
        x, y = point(source, target, p.x, p.y)
        return F.when(p.isNotNull(), F.struct(x.alias("x"), y.alias("y")))

    out = sel.withColumn("__ring", F.transform(F.coalesce(ring, box), moved))
    edge = lambda f, c: f(F.transform("__ring", lambda p: p[c]))
    out = out.withColumns({"x0": edge(F.array_min, "x"), "y0": edge(F.array_min, "y"), "x1": edge(F.array_max, "x"), "y1": edge(F.array_max, "y"), "ring": F.when(~lone, F.col("__ring"))})
    return out.drop("__ring")


def wrap_selections(sel: DataFrame) -> DataFrame:
    """Boxes in 0..360 turned to -180..180; one that straddles 180 becomes two with one ugid."""
    left = sel.where("x0 < 180").withColumn("x1", F.least("x1", F.lit(180.0)))
    right = sel.where("x1 > 180").withColumn("x0", F.greatest("x0", F.lit(180.0)) - 360).withColumn("x1", F.col("x1") - 360)
    return left.unionByName(right)


def unwrap_selections(sel: DataFrame) -> DataFrame:
    """Boxes in -180..180 turned to 0..360; one that straddles 0 becomes two with one ugid."""
    right = sel.where("x1 > 0").withColumn("x0", F.greatest("x0", F.lit(0.0)))
    left = sel.where("x0 < 0").withColumn("x1", F.least("x1", F.lit(0.0)) + 360).withColumn("x0", F.col("x0") + 360)
    return left.unionByName(right)


def area(f: Field) -> Column:
    x0, y0, x1, y1 = edges(f)
    return (x1 - x0) * (y1 - y0)


def weighted_average(f: Field, weight: Column | None = None) -> Field:
    """Spatial average over all keys but x and y: the sum of weight times value over the sum of weights of values that are there.

    The weight is the cell's area, or 1 where it has none. Sums are combined from partial ones, so any partitioning gives the same.
    """
    own = F.col("__area") if "__area" in f.df.columns else area(f) if f.bounds("x") and f.bounds("y") else F.lit(1.0)
    own = weight if weight is not None else own
    w = F.when(own > 0, own).otherwise(1.0)
    gone = {f.dims.column("x"), f.dims.column("y"), "__area", "gid", "GID", *(f.bounds("x") or ()), *(f.bounds("y") or ()), *f.variables}
    keys = [c for c in f.df.columns if c not in gone]
    sums = [(F.sum(w * F.col(v)) / F.sum(F.when(F.col(v).isNotNull(), w))).alias(v) for v in f.variables]
    dims = type(f.dims)({k: v for k, v in f.dims.axes.items() if k not in ("x", "y")}, {k: v for k, v in f.dims.bounds.items() if k not in ("x", "y")}, f.dims.crs)
    return f.with_df(f.df.groupBy(*keys).agg(*sums), dims=dims)


def extent(f: Field) -> DataFrame:
    x0, y0, x1, y1 = edges(f)
    return f.df.agg(F.min(x0).alias("min_x"), F.min(y0).alias("min_y"), F.max(x1).alias("max_x"), F.max(y1).alias("max_y"))


def resolution(f: Field, axis: str, first: int = 100) -> DataFrame:
    """The mean step between neighbouring coordinates, over the first of them."""
    c = f.dims.column(axis)
    w = W.orderBy(c)
    steps = f.df.select(c).distinct().withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= first)
    return steps.withColumn("__step", F.abs(F.abs(F.col(c)) - F.abs(F.lag(c).over(w)))).agg(F.avg("__step").alias("resolution"))


def bounds_1d(coords: DataFrame, name: str) -> DataFrame:
    """(coordinate, lb, ub) of a table of coordinates: midpoints, and at the ends the same step as between the outer ones."""
    w = W.orderBy(name)
    lead, lag, c = F.lead(name).over(w), F.lag(name).over(w), F.col(name)
    mid = coords.select(name).distinct().withColumns({"__up": (c + lead) / 2, "__down": (c + lag) / 2})
    steps = mid.withColumn("__gap", F.col("__up") - F.lag("__up").over(w))
    only = steps.agg(F.avg("__gap").alias("__mean"), F.max(c).alias("__max"), F.min(c).alias("__min"))
    wide = steps.join(F.broadcast(only)).withColumn("__mean", F.coalesce("__mean", F.col("__max") - F.col("__min")))
    return wide.select(name, F.coalesce("__down", F.col("__up") - F.col("__mean")).alias(f"lb_{name}"), F.coalesce("__up", F.col("__down") + F.col("__mean")).alias(f"ub_{name}"))


def with_bounds(f: Field, axis: str) -> Field:
    """A field with bounds interpolated on an axis."""
    from isobar.errors import BoundsPresentError

    if f.bounds(axis):
        raise BoundsPresentError(f"axis {axis} has bounds")
    c = f.dims.column(axis)
    table = bounds_1d(f.df.select(c), c)
    dims = type(f.dims)(f.dims.axes, {**f.dims.bounds, axis: (f"lb_{c}", f"ub_{c}")}, f.dims.crs)
    return f.with_df(f.df.join(table, c), dims=dims)


def corners(f: Field) -> Column:
    """A cell's corners, counter-clockwise from the lower left."""
    x0, y0, x1, y1 = edges(f)
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))


def tiles(f: Field, size: float) -> Field:
    """A field with the tile of each cell, to partition by."""
    return f.with_df(f.df.withColumns({"tile_x": F.floor(f.axis("x") / size), "tile_y": F.floor(f.axis("y") / size)}))


def reorder(f: Field, name: str = "x_index") -> Field:
    """Places of wrapped x coordinates in ascending order, from 0."""
    from isobar.operators.filters import with_index

    return with_index(f, "x", name)


def wrap_ring(ring: list[tuple[float, float]], unwrap: bool = False) -> list[list[tuple[float, float]]]:
    """A ring in 0..360 as rings in -180..180 (or the other way round), cut where it passes the edge."""
    if unwrap:
        parts = [(cut_ring(ring, (0.0, -90.0, 180.0, 90.0)), 0.0), (cut_ring(ring, (-180.0, -90.0, 0.0, 90.0)), 360.0)]
    else:
        parts = [(cut_ring(ring, (0.0, -90.0, 180.0, 90.0)), 0.0), (cut_ring(ring, (180.0, -90.0, 360.0, 90.0)), -360.0)]
    return [[(x + d, y) for x, y in p] for p, d in parts if area_of(p) > 0]


def corners_2d(df: DataFrame, iy: str, ix: str, x: str, y: str) -> DataFrame:
    """(iy, ix, ring): corners of a curvilinear grid's cells, from its centres.

    A corner is the mean of the four centres around it; beyond the edges centres go on with the step before them. Each
    centre is sent to the four corners that it counts for, so the grid is never in one task.
    """
    size = df.agg(F.min(iy).alias("a"), F.max(iy).alias("b"), F.min(ix).alias("c"), F.max(ix).alias("d"))

    def beyond(points: DataFrame, axis: str, low: str, high: str) -> DataFrame:
        """Points, and one more beyond each end of an axis, reflected about the end."""
        ends = points.join(F.broadcast(size))
        step = F.when(F.col(axis) == F.col(low), -1).when(F.col(axis) == F.col(high), 1)
        last = ends.where(step.isNotNull()).withColumn("__to", F.col(axis) + step).withColumn("__one", F.col(axis) - step)
        other = [iy if axis == ix else ix]
        inner = points.select(F.col(axis).alias("__one"), *other, F.col(x).alias("__x"), F.col(y).alias("__y"))
        grown = last.join(inner, ["__one", *other]).select(F.col("__to").alias(axis), *other, (2 * F.col(x) - F.col("__x")).alias(x), (2 * F.col(y) - F.col("__y")).alias(y))
        return points.unionByName(grown)

    wide = beyond(beyond(df.select(iy, ix, x, y), iy, "a", "b"), ix, "c", "d")
    around = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1))))
    nodes = wide.withColumn("__o", around).groupBy((F.col(iy) + F.col("__o.a")).alias("ny"), (F.col(ix) + F.col("__o.b")).alias("nx")).agg(F.avg(x).alias("x"), F.avg(y).alias("y"), F.count("*").alias("n")).where("n = 4")
    place = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in enumerate(((0, 0), (0, 1), (1, 1), (1, 0))))))
    cells = df.select(iy, ix, place.alias("__p")).select(iy, ix, F.col("__p.k").alias("k"), (F.col(iy) + F.col("__p.a")).alias("ny"), (F.col(ix) + F.col("__p.b")).alias("nx"))
    ring = F.transform(F.array_sort(F.collect_list(F.struct("k", "x", "y"))), lambda p: F.struct(p.x.alias("x"), p.y.alias("y")))
    return cells.join(nodes, ["ny", "nx"]).groupBy(iy, ix).agg(ring.alias("ring"))
