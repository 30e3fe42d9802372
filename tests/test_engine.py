"""The engine on a small fixture of known values, and parts that SQL doesn't reach."""

import json
import math
import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from isobar import sinks
from isobar.errors import BoundsPresentError, DefinitionError, EmptySubsetError, IncompleteSeasonError, RegridError, UnitsError
from isobar.functions import calendars, units
from isobar.functions.crs import Crs, from_cartesian, geographic_to_rotated, project, rotated_to_geographic, to_cartesian, transform, unproject, wrap, wrapped_state
from isobar.functions.library import Calculation, register
from isobar.model import DimensionMap, Field
from isobar.operators import filters, regrid, spatial
from isobar.operators.grouping import Grouping
from isobar.plans.calculate import calculate, parse_calc, thaws
from isobar.plans.request import Request
from isobar.sources import mesh, netcdf
from isobar.sources.datasets import Dataset, driver_for, meta_json
from isobar.sources.vector import Cabinet
from isobar.streaming.windows import run_to_table, windowed


@pytest.fixture(scope="module")
def simple(spark):
    """61 days, 2 levels, 4 by 4 cells whose values are 1 to 4 by quadrant."""
    rows = []
    for day in range(61):
        t = datetime(2000, 3, 1, 12) + timedelta(days=day)
        for level, lo, hi in ((50.0, 0.0, 100.0), (150.0, 100.0, 200.0)):
            for j in range(4):
                for i in range(4):
                    x, y = -105.0 + i, 37.0 + j
                    rows.append((t, t - timedelta(hours=12), t + timedelta(hours=12), level, lo, hi, y, y - 0.5, y + 0.5, x, x - 0.5, x + 0.5, 1.0 + (i > 1) + 2 * (j > 1)))
    df = spark.createDataFrame(rows, "time timestamp_ntz, lb_time timestamp_ntz, ub_time timestamp_ntz, level double, lb_level double, ub_level double, y double, lb_y double, ub_y double, x double, lb_x double, ub_x double, foo double").cache()
    return Field.of(df, units={"foo": "K"})


def test_dimension_map(simple):
    assert simple.dims.axes == {"time": "time", "level": "level", "y": "y", "x": "x"}
    assert simple.dims.bounds["time"] == ("lb_time", "ub_time") and simple.variables == ("foo",)
    assert "axis x: x" in simple.describe() and json.loads(meta_json(simple))["variables"] == {"foo": {"units": "K"}}


def test_monthly_mean(simple):
    f = calculate(simple, "mean", ["month", "year"], sample_size=True)
    rows = f.df.collect()
    assert len(rows) == 2 * 2 * 16
    march = next(r for r in rows if r.month == 3 and r.level == 50 and r.x == -105 and r.y == 37)
    assert (march.time, march.lb_time, march.ub_time) == (datetime(2000, 3, 16), datetime(2000, 3, 1), datetime(2000, 4, 1))
    assert march["mean"] == 1.0 and march.n_foo == 31
    assert f.units["mean"] == "K"


def test_spatial_average(simple):
    values = {r.foo for r in Request(simple, aggregate=True).execute(simple.df.sparkSession).collect()}
    assert values == {2.5}


def test_clip_and_average(simple):
    r = Request(simple, geom=[(-105.0, 36.5, -102.5, 37.5)], spatial_operation="clip", aggregate=True, level_range=(0, 90), calc="mean", calc_grouping="all")
    (row,) = r.execute(simple.df.sparkSession).collect()
    assert row["mean"] == pytest.approx((0.5 * 1 + 1 * 1 + 1 * 2) / 2.5)


def test_touches(simple):
    sel = spatial.selections(simple.df.sparkSession, "-104.5|36.5|-103.5|37.5")
    one = simple.where("level = 50 and time = timestamp_ntz'2000-03-01 12:00:00'")
    assert spatial.intersects(one, sel).df.count() == 1
    assert spatial.intersects(one, sel, touch=True).df.count() == 6


def test_polygon(simple):
    one = simple.where("level = 50 and time = timestamp_ntz'2000-03-01 12:00:00'")
    ring = [(-105.0, 37.0), (-103.0, 37.0), (-103.0, 39.0)]
    sel = spatial.selections(simple.df.sparkSession, [ring])
    assert {(r.x, r.y) for r in spatial.intersects(one, sel).df.collect()} == {(-105, 37), (-104, 37), (-103, 37), (-104, 38), (-103, 38), (-103, 39)}
    assert spatial.clip(one, sel).df.agg(F.sum("__area")).first()[0] == pytest.approx(2.0)


def square(x, y, side, hole=False):
    ring = [(x, y), (x + side, y), (x + side, y + side), (x, y + side)]
    return ring[::-1] if hole else ring


#: A square with a square hole, and a second part beside it.
PARTS = [square(0.0, 0.0, 8.0), square(2.0, 2.0, 4.0, True), square(10.0, 0.0, 2.0)]


@pytest.fixture(scope="module")
def fine(spark):
    """Cells of side 1 from 0 to 14 by 0 to 10."""
    rows = [(x + 14 * y, x + 0.5, y + 0.5, float(x), x + 1.0, float(y), y + 1.0, 1.0) for x in range(14) for y in range(10)]
    return Field.of(spark.createDataFrame(rows, "gid int, x double, y double, lb_x double, ub_x double, lb_y double, ub_y double, v double"))


def in_parts(x, y):
    inside = lambda a, b, side: a < x < a + side and b < y < b + side
    return inside(0, 0, 8) and not inside(2, 2, 4) or inside(10, 0, 2)


def test_parts_and_holes(spark, fine):
    want = {(r.x, r.y) for r in fine.df.collect() if in_parts(r.x, r.y)}
    sel = spatial.selections(spark, [{"geom": PARTS}])
    at = lambda f: {(r.x, r.y) for r in f.df.collect()}
    assert at(spatial.intersects(fine, sel)) == want == at(spatial.intersects(fine.drop_bounds("x", "y"), sel))
    assert at(spatial.union_intersects(fine, sel)) == want
    assert spatial.clip(fine, sel).df.agg(F.sum("__area")).first()[0] == pytest.approx(64 - 16 + 4)
    near = lambda x, y: min(math.hypot(max(a - x, 0, x - b), max(c - y, 0, y - d)) for a, b, c, d in ((0, 8, 0, 2), (0, 8, 6, 8), (0, 2, 0, 8), (6, 8, 0, 8), (10, 12, 0, 2)))
    points = {(r.x, r.y) for r in fine.df.collect() if near(r.x, r.y) <= 1.2}
    assert at(spatial.intersects(fine.drop_bounds("x", "y"), spatial.buffered(sel, 1.2))) == points
    boxes = {(r.x, r.y) for r in fine.df.collect() if min(near(min(max(r.x, r.x - 0.5), r.x + 0.5), r.y), *(near(r.x + a / 50, r.y + b / 50) for a in range(-25, 26, 5) for b in range(-25, 26, 5))) < 1.2}
    assert at(spatial.intersects(fine, spatial.buffered(sel, 1.2))) == boxes


def test_union_of_rings(spark, fine):
    sel = spatial.selections(spark, [[(0.0, 0.0), (8.0, 0.0), (0.0, 8.0)], (12.0, 8.0, 14.0, 10.0)])
    points = fine.drop_bounds("x", "y")
    want = {r.gid for r in fine.df.collect() if r.x + r.y < 8 or (r.x > 12 and r.y > 8)}
    assert {r.gid for r in spatial.union_intersects(points, sel).df.collect()} == want
    assert {r.gid for r in spatial.union_intersects(points, sel, tile=3.0).df.collect()} == want


def test_parts_of_files(spark, fine, tmp_path):
    sinks.write_shapefile([(spatial.together([r[::-1] for r in PARTS]), {"UGID": 4}), (square(3.0, 3.0, 1.0), {"UGID": 5})], str(tmp_path / "several.shp"))
    loop = lambda r: [list(p) for p in (*r, r[0])]
    shapes = [{"type": "MultiPolygon", "coordinates": [[loop(PARTS[0]), loop(PARTS[1][::-1])], [loop(PARTS[2][::-1])]]}, {"type": "Polygon", "coordinates": [loop(PARTS[0]), loop(PARTS[1])]}]
    text = json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"a": "b"}, "geometry": g} for g in shapes]})
    (tmp_path / "more.geojson").write_text(text)
    box = Cabinet(str(tmp_path))
    for key, ids, areas in (("several", (4, 5), (52, 1)), ("more", (1, 2), (52, 48))):
        cut = spatial.clip(fine, box.read(spark, key)).df.groupBy("UGID").agg(F.sum("__area").alias("a")).orderBy("UGID").collect()
        assert [(r.UGID, round(r.a, 9)) for r in cut] == list(zip(ids, areas, strict=True))


def test_plans_of_spatial_joins(spark, fine, tmp_path):
    """Many selections meet distinct cells by tile; no plan compares rows with selections."""
    rows = [(k, 0.001 * k, 0.0, 0.001 * k + 0.5, 0.5, None, None) for k in range(12_000)]
    sel = spark.createDataFrame(rows, f"ugid int, x0 double, y0 double, x1 double, y1 double, ring {spatial.RING}, properties map<string,string>")
    times = fine.with_df(fine.df.withColumn("time", F.explode(F.sequence(F.lit(0), F.lit(4)))))
    found = spatial.intersects(times, sel).df
    assert found.groupBy("time").count().select("count").distinct().count() == 1
    assert found.where("time = 0").count() == sum(1 for k in range(12_000) for x in range(14) if x < 0.001 * k + 0.5 and x + 1 > 0.001 * k)
    points = times.drop_bounds("x", "y")
    plans = [found, spatial.union_intersects(times, sel).df, spatial.within_radius(points, sel, 0.7).df]
    for df in plans:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, plan


def test_nearest_without_a_centre(spark, fine):
    rows = [(1, 0.4, 0.4, 0.6, 0.6), (2, None, 1.0, None, 1.0), (3, 900.0, -900.0, 900.0, -900.0), (4, None, None, None, None)]
    sel = spark.createDataFrame(rows, "ugid int, x0 double, y0 double, x1 double, y1 double")
    for tile in (None, 0.3):
        assert sorted((r.UGID, r.gid) for r in spatial.nearest(fine, sel, "gid", tile).df.collect()) == [(1, 0), (3, 13)]
    assert spatial.nearest(fine.where("v > 1"), sel, "gid").df.count() == 0
    assert spatial.nearest(fine, sel.where("ugid = 2"), "gid").df.count() == 0


def test_ring_meets_box_where_only_sides_cross(spark):
    df = spark.range(1).select(F.lit(0.0).alias("a"), F.lit(1.0).alias("b"), F.expr("array(named_struct('x', -1D, 'y', 0.4D), named_struct('x', 2D, 'y', 0.4D), named_struct('x', 2D, 'y', 0.6D), named_struct('x', -1D, 'y', 0.6D))").alias("r"))
    assert df.select(spatial.ring_meets_box(F.col("r"), F.col("a"), F.col("a"), F.col("b"), F.col("b"))).first()[0]
    assert not df.select(spatial.ring_meets_box(F.col("r"), F.col("a"), F.lit(0.7), F.col("b"), F.col("b"))).first()[0]


def test_many_selections_by_tiles(simple, spark):
    r = random.Random(2)
    cells = [(k, r.uniform(0, 50), r.uniform(0, 50)) for k in range(400)]
    f = Field.of(spark.createDataFrame([(k, x, y, 1.0) for k, x, y in cells], "gid int, x double, y double, v double"))
    areas = [(x, y, x + r.uniform(0, 9), y + r.uniform(0, 9)) for x, y in ((r.uniform(-30, 70), r.uniform(0, 50)) for _ in range(25))]
    sel = spatial.selections(spark, areas)
    pairs = lambda g: sorted((a.UGID, a.gid) for a in g.df.collect())
    assert pairs(spatial.nearest(f, sel, "gid", tile=0.5)) == pairs(spatial.nearest(f, sel, "gid"))
    assert pairs(spatial.union_intersects(f, sel, tile=3.0)) == pairs(spatial.union_intersects(f, sel))
    assert pairs(spatial.intersects(f, sel, tile=3.0)) == pairs(spatial.intersects(f, sel))


def test_bounds_of_time(simple):
    f = filters.time_range(simple, datetime(2000, 3, 5), datetime(2000, 3, 6))
    assert sorted({r.time.day for r in f.df.collect()}) == [5, 6]
    f = filters.time_range(simple, datetime(2000, 3, 5), datetime(2000, 3, 6), exclusive=True)
    assert sorted({r.time.day for r in f.df.collect()}) == [5]


def test_slices(simple):
    assert filters.slice_axes(simple, [None, -2, 0, (0, 2), None]).df.count() == 2 * 1 * 2 * 4
    assert filters.slice_axes(simple, {"time": 3}).df.select("time").distinct().collect()[0].time == datetime(2000, 3, 4, 12)
    assert filters.snippet(simple).df.count() == 16


def test_empty_subset(simple):
    r = Request(simple, time_range=(datetime(1990, 1, 1), datetime(1990, 1, 2)), allow_empty=False)
    with pytest.raises(EmptySubsetError):
        r.execute(simple.df.sparkSession)


@pytest.mark.parametrize(
    "wrong",
    [
        {"spatial_operation": "cut"},
        {"snippet": True, "calc": "mean", "calc_grouping": "all"},
        {"output_format": "xls"},
        {"time_range": (datetime(2001, 1, 1), datetime(2000, 1, 1))},
        {"calc": "x=foo", "calc_grouping": ["month"]},
        {"calc_grouping": ["week"], "calc": "mean"},
        {"spatial_reorder": True, "aggregate": True},
        {"file_only": True},
        {"select_nearest": True},
        {"calc": "nothing", "calc_grouping": "all"},
        {"calc": [{"func": "threshold", "kwds": {"threshold": 1}}], "calc_grouping": "all"},
        {"calc": [{"func": "mean", "kwds": {"a": 1}}], "calc_grouping": "all"},
        {"calc": "mean"},
        {"calc": ["mean", "mean"], "calc_grouping": "all"},
        {"calc": "y=__import__('os')"},
        {"calc": "y=foo.real"},
        {"calc": "moving_window!k~4!operation~mean"},
        {"calc": "duration!threshold~1!operation~gt", "calc_grouping": ["month"]},
    ],
)
def test_requests_that_contradict_themselves(simple, wrong):
    with pytest.raises(DefinitionError):
        Request(simple, **wrong).execute(simple.df.sparkSession)


def test_grouping_parse():
    assert Grouping.parse(["month", "year"]).names == ["year", "month"]
    assert Grouping.parse([[12, 1, 2], [6, 7, 8], "unique"]).seasons == ((6, 7, 8), (12, 1, 2))
    with pytest.raises(DefinitionError):
        Grouping.parse([[1, 2], [2, 3]])
    with pytest.raises(IncompleteSeasonError):
        Grouping.parse([[1, 4, 7], "unique"])


def test_parse_calc():
    assert parse_calc("threshold~hot!threshold~5!operation~gt") == [{"func": "threshold", "name": "hot", "kwds": {"threshold": "5", "operation": "gt"}}]
    assert parse_calc("a=foo+1")[0]["name"] == "a"


def test_query_string(simple):
    r = Request.from_query("calc=mean|max&calc_grouping=month|year&time_range=2000-03-01|2000-03-31&level_range=0|90&time_region=month~3|4,year~2000&aggregate=true&geom=-105|37|-103|39", simple)
    assert r.calc == ["mean", "max"] and r.aggregate and r.time_region == {"month": [3, 4], "year": [2000]}
    assert r.execute(simple.df.sparkSession).count() == 1
    with pytest.raises(DefinitionError):
        Request.from_query("colour=red", simple)


def test_duration_quirks(spark):
    def lengths(text, summary):
        rows = [(datetime(2000, 1, 1) + timedelta(days=k), 1.0, 1.0, float(c == "T")) for k, c in enumerate(text)]
        f = Field.of(spark.createDataFrame(rows, "time timestamp_ntz, x double, y double, v double"))
        return calculate(f, f"duration!threshold~0.5!operation~gt!summary~{summary}", ["year"]).df.first()["duration"]

    assert lengths("TFTFT", "std") == 1 and lengths("TTFTF", "mean") == 1.5 and lengths("FFFF", "max") == 0 and lengths("TTTF", "std") == 3


def brute_thaws(x, threshold):
    """Changes of state, sum by sum: each is begun at a change of sign and followed to the end."""
    begins = [0] + [k for k in range(len(x)) if (x[k] >= 0) != (k == 0 or x[k - 1] >= 0)]
    side, since, changes = 0, 0, -1
    for begin in begins:
        total = 0.0
        for k in range(begin, len(x)):
            total += x[k]
            if abs(total) >= threshold:
                if begin >= since and np.sign(total) != side:
                    side, since, changes = np.sign(total), k + 1, changes + 1
                break
    return changes


def test_freezethaw(spark):
    known = [([-10] * 3 + [10] * 3 + [-10] * 3, 15, 2), ([5] * 10, 15, 0), ([-10, 10] * 5, 15, -1), ([0, 7, -1, 9, 0, -15, 0], 15, 1), ([0, 1, 2, 3, 0, -1, 0, 1, -2, -3, 3], 2, 2), ([3, 4, 5, 2, 3, -3, 4, 5, -5, -6, -3, 0, -1, 4, 5, 2, -3, -5, 6], 2, 6), ([], 15, -1)]
    r = random.Random(11)
    series = [[float(r.randint(-9, 9)) for _ in range(r.randint(1, 60))] for _ in range(300)]
    for threshold in (2, 15, 31):
        rows = [([float(v) for v in x], float(n)) for x, t, n in known if t == threshold] + [(x, float(brute_thaws(x, threshold))) for x in series]
        found = spark.createDataFrame(rows, "x array<double>, want double").select("x", "want", thaws(F.col("x"), float(threshold)).alias("got")).where("got <> want").collect()
        assert found == []


def brute_daily(rows, p, width, leap):
    """Percentile by calendar day over days within half a window, in each year apart."""
    half, out = width // 2, {}
    days = {(t.month, t.day) for t, _ in rows}
    for m, d in days:
        picked = []
        for t, v in rows:
            if (m, d) == (2, 29) and not leap:
                near = timedelta(days=-(half - 1)) <= t.date() - date(t.year, 2, 28) <= timedelta(days=half)
            else:
                near = False
                for y in (t.year - 1, t.year, t.year + 1):
                    try:
                        near |= abs((t.date() - date(y, m, d)).days) <= half
                    except ValueError:
                        pass
            if near:
                picked.append(v)
        out[m, d] = np.percentile(picked, p)
    return out


@pytest.mark.parametrize("leap", [False, True])
def test_daily_percentile(spark, leap):
    r = random.Random(1)
    rows = [(datetime(1999, 1, 1) + timedelta(days=k), r.random()) for k in range(365 * 3 + 1)]
    f = Field.of(spark.createDataFrame([(t, 1.0, v) for t, v in rows], "time timestamp_ntz, x double, v double"))
    found = calculate(f, {"func": "daily_perc", "kwds": {"percentile": 90, "window_width": 5, "only_leap_years": leap}}).df.collect()
    want = brute_daily(rows, 90, 5, leap)
    assert {(x.month, x.day) for x in found} == set(want)
    assert all(x.daily_perc == pytest.approx(want[x.month, x.day]) for x in found)


def test_user_functions(simple):
    register(Calculation("twice", "set", lambda x: 2 * F.avg(x)))
    register(Calculation("both", "field", lambda f, **_: f.with_df(f.df.withColumn("bar", F.col("foo") * 3), variables=("foo", "bar"))))
    assert {r.twice for r in calculate(simple, "twice", "all").df.collect()} == {2.0, 4.0, 6.0, 8.0}
    assert calculate(simple, "both").variables == ("foo", "bar")


def test_convolution_is_numpys(spark):
    r = np.random.default_rng(0)
    a, v = r.normal(size=30), [0.2, 0.5, 1.0, -0.3]
    f = Field.of(spark.createDataFrame([(datetime(2000, 1, 1) + timedelta(days=k), 1.0, float(x)) for k, x in enumerate(a)], "time timestamp_ntz, x double, v double"))
    for mode in ("same", "valid"):
        got = [x.convolve_1d for x in calculate(f, {"func": "convolve_1d", "kwds": {"v": v, "mode": mode}}).df.orderBy("time").collect()]
        want = np.convolve(a, v, mode)
        assert np.allclose([x for x in got if x is not None], want)


def test_units():
    assert units.factors("K", "C") == (1.0, -273.15) and units.equal("celsius", "degC") and units.convertible("mm/day", "kg m-2 s-1")
    scale, offset = units.factors("C", "F")
    assert 100 * scale + offset == pytest.approx(212)
    for bad in ((None, "K"), ("K", "m"), ("abc", "K")):
        with pytest.raises(UnitsError):
            units.factors(*bad)


def test_units_of_heat_index(simple):
    f = Field.of(simple.df.select("time", "x", F.col("foo").alias("t"), F.col("foo").alias("h")), ("t", "h"), units={"t": "K", "h": "percent"})
    with pytest.raises(UnitsError):
        calculate(f, {"func": "heat_index", "kwds": {"tas": "t", "rhs": "h"}})


@pytest.mark.parametrize(
    "crs",
    [
        Crs("albers", {"lat_1": 29.5, "lat_2": 45.5, "lat_0": 23.0, "lon_0": -96.0}),
        Crs("lambert", {"lat_1": 30.0, "lat_2": 60.0, "lat_0": 47.5, "lon_0": -97.0, "x_0": 3325000.0, "y_0": 2700000.0}),
        Crs("lambert", {"lat_1": 40.0, "lat_0": 40.0, "lon_0": -97.0}),
        Crs("stereographic", {"lat_ts": 60.0, "lat_0": 90.0, "lon_0": -97.0}),
        Crs("stereographic", {"lat_ts": -71.0, "lat_0": -90.0, "lon_0": 0.0}),
    ],
)
def test_projections_turn_back(spark, crs):
    df = spark.createDataFrame([(float(x), float(y)) for x in range(-140, -60, 20) for y in range(20, 70, 10)], "x double, y double")
    px, py = project(crs, F.col("x"), F.col("y"))
    lon, lat = unproject(crs, F.col("px"), F.col("py"))
    for r in df.withColumns({"px": px, "py": py}).withColumns({"lon": lon, "lat": lat}).collect():
        assert math.isclose((r.lon - r.x + 180) % 360 - 180, 0, abs_tol=1e-8) and r.lat == pytest.approx(r.y, abs=1e-8)
    assert Crs.from_cf(crs.to_cf()).matches(crs) and Crs.from_proj4(crs.to_proj4()).kind == crs.kind


def test_selections_go_into_the_fields_system(spark):
    crs = Crs("albers", {"lat_1": 29.5, "lat_2": 45.5, "lat_0": 23.0, "lon_0": -96.0})
    lonlat = spark.createDataFrame([(k, -110.0 + k % 20, 30.0 + k // 20) for k in range(300)], "gid int, lon double, lat double")
    x, y = project(crs, F.col("lon"), F.col("lat"))
    f = Field.of(lonlat.select("gid", "lon", "lat", x.alias("x"), y.alias("y"), F.lit(1.0).alias("v")), ("v",), DimensionMap(crs=crs))
    ring = [(-104.6, 31.5), (-96.2, 33.5), (-99.3, 42.5)]
    px, py = project(crs, F.col("a"), F.col("b"))
    flat = [tuple(r) for r in spark.createDataFrame(ring, "a double, b double").select(px, py).collect()]
    inside = lambda p: sum((a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(flat, [*flat[1:], flat[0]], strict=True)) % 2 == 1
    want = sorted(r.gid for r in f.df.collect() if inside((r.x, r.y)))
    got = lambda geom, **more: sorted(r.gid for r in Request(f, geom=geom, **more).execute(spark).collect())
    assert got([ring]) == want == got([flat], geom_crs=crs) and 20 < len(want) < 100
    assert got([(-105.3, 33.6)], select_nearest=True) == [5 + 20 * 4]
    near = got([(-104.4, 32.6, -100.4, 35.4)])  # a box between the grid's lines, whose sides bend by less than half a step
    assert near == sorted(r.gid for r in lonlat.where("lon between -104.4 and -100.4 and lat between 32.6 and 35.4").collect())


def test_lambert_of_the_origin(spark):
    crs = Crs("lambert", {"lat_1": 30.0, "lat_2": 60.0, "lat_0": 47.5, "lon_0": -97.0, "x_0": 10.0, "y_0": 20.0})
    x, y = project(crs, F.lit(-97.0), F.lit(47.5))
    assert spark.range(1).select(x, y).first() == (pytest.approx(10.0), pytest.approx(20.0))


def test_sphere_and_rotated_pole(spark):
    df = spark.createDataFrame([(float(x), float(y)) for x in range(-170, 180, 30) for y in range(-80, 90, 20)], "x double, y double")
    lon, lat, _ = from_cartesian(*to_cartesian(F.col("x"), F.col("y")))
    a, b = geographic_to_rotated(F.col("x"), F.col("y"), -162.0, 39.25)
    c, d = rotated_to_geographic(F.col("a"), F.col("b"), -162.0, 39.25)
    for r in df.select("x", "y", lon.alias("lon"), lat.alias("lat"), a.alias("a"), b.alias("b")).withColumns({"c": c, "d": d}).collect():
        assert (r.lon, r.lat) == (pytest.approx(r.x), pytest.approx(r.y))
        assert abs((r.c - r.x + 180) % 360 - 180) < 1e-7 and r.d == pytest.approx(r.y, abs=1e-8)


def test_wrapping(spark):
    df = spark.createDataFrame([(float(x), x - 0.5, x + 0.5, 1.0, float(x)) for x in (0, 90, 180, 181, 359)], "x double, lb_x double, ub_x double, y double, v double")
    f = Field.of(df)
    assert wrapped_state(f) == "unwrapped" and wrapped_state(wrap(f)) == "wrapped"
    assert sorted(r.lb_x for r in wrap(f).df.collect()) == [-179.5, -1.5, -0.5, 89.5, 179.5]
    assert transform(f, Crs(), Crs("wgs84")) is f
    parts = spatial.wrap_ring([(170.0, 0.0), (190.0, 0.0), (190.0, 10.0), (170.0, 10.0)])
    assert sorted((min(x for x, _ in p), max(x for x, _ in p)) for p in parts) == [(-180.0, -170.0), (170.0, 180.0)]
    two = spatial.unwrap_selections(spatial.selections(spark, [(-10.0, 0.0, 10.0, 5.0)])).collect()
    assert sorted((r.x0, r.x1) for r in two) == [(0.0, 10.0), (350.0, 360.0)]


def test_bounds(simple, spark):
    table = {r.x: (r.lb_x, r.ub_x) for r in spatial.bounds_1d(spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "x double"), "x").collect()}
    assert table == {1.0: (0.0, 1.5), 2.0: (1.5, 3.0), 4.0: (3.0, 4.5)}
    assert {r.x: (r.lb_x, r.ub_x) for r in spatial.bounds_1d(spark.createDataFrame([(1.0,), (3.0,)], "x double"), "x").collect()} == {1.0: (0.0, 2.0), 3.0: (2.0, 4.0)}
    with pytest.raises(BoundsPresentError):
        spatial.with_bounds(simple, "x")
    bare = simple.drop_bounds("x", "y")
    assert Request(bare, interpolate_spatial_bounds=True, aggregate=True).execute(spark).first().foo == 2.5


def test_corners_of_a_curvilinear_grid(spark):
    df = spark.createDataFrame([(j, i, float(i + 0.1 * j), float(j)) for j in range(3) for i in range(4)], "iy int, ix int, x double, y double")
    cells = {(r.iy, r.ix): [(p.x, p.y) for p in r.ring] for r in spatial.corners_2d(df, "iy", "ix", "x", "y").collect()}
    assert len(cells) == 12
    assert np.allclose(cells[0, 0], [(-0.55, -0.5), (0.45, -0.5), (0.55, 0.5), (-0.45, 0.5)])


def test_orientation(spark):
    df = spark.createDataFrame([([(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0)],)], f"r {spatial.RING}")
    a, b = df.select(spatial.ring_area(F.col("r")), spatial.ring_area(spatial.counter_clockwise(F.col("r")))).first()
    assert (a, b) == (-4.0, 4.0)


def test_regrid_keeps_linear_fields(simple, spark):
    one = simple.where("level = 50 and time = timestamp_ntz'2000-03-01 12:00:00'").transform(lambda df: df.withColumn("foo", 2 * F.col("x") + 3 * F.col("y")))
    dest = Field.of(spark.createDataFrame([(-104.3, 38.2), (-103.0, 37.0), (-102.0, 40.0), (-90.0, 38.0)], "x double, y double").withColumn("v", F.lit(0.0)), ("v",))
    got = {(r.x, r.y): r.foo for r in regrid.regrid(one, dest, "bilinear").df.collect()}
    assert len(got) == 3 * 4 and all(v == pytest.approx(2 * x + 3 * y) for (x, y), v in got.items())
    with pytest.raises(RegridError):
        regrid.regrid(one, dest, "conserve")
    same = regrid.regrid(one, one, "auto").df.count()
    assert same == 16


def bands(spark, edges, values=None):
    rows = [(x + 5.0, x, x + 10.0, (a + b) / 2, a, b, None if values is None else values[k]) for x in (0.0, 10.0) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    return Field.of(spark.createDataFrame(rows, "x double, lb_x double, ub_x double, y double, lb_y double, ub_y double, v double"), ("v",))


def test_regrid_on_the_sphere(spark, tmp_path):
    src, whole = bands(spark, [0.0, 30.0, 90.0], [1.0, 3.0]), bands(spark, [0.0, 90.0])
    at = lambda f: sorted((r.x, r.y, round(r.v, 9)) for r in f.df.collect())
    want = [(5.0, 45.0, 2.0), (15.0, 45.0, 2.0)]  # half of a hemisphere lies below 30 degrees
    assert at(regrid.regrid(src, whole)) == want
    assert at(regrid.regrid(src, whole, weights_out=f"{tmp_path}/w")) == want == at(regrid.regrid(src, whole, weights_in=f"{tmp_path}/w"))
    assert at(regrid.regrid(src, whole, value_mask=F.col("v") > 2)) == [(5.0, 45.0, 1.0), (15.0, 45.0, 1.0)]
    # what is conserved: the sum of area times value over all cells
    area = lambda f: f.df.agg(F.sum((F.col("ub_x") - F.col("lb_x")) * (F.sin(F.radians("ub_y")) - F.sin(F.radians("lb_y"))) * F.col("v"))).first()[0]
    r = random.Random(3)
    src, dest = bands(spark, [-90.0, -41.0, -3.0, 20.0, 55.0, 90.0], [r.random() for _ in range(5)]), bands(spark, [-90.0, -60.0, 11.0, 33.0, 90.0])
    found = regrid.regrid(src, dest)
    placed = found.with_df(found.df.join(dest.df.drop("v"), ["x", "y"]))
    assert area(placed) == pytest.approx(area(src))
    by_table = regrid.apply_weights(src, regrid.weights(src, dest))
    assert at(found) == at(by_table)


def test_regrid_refuses(spark, simple):
    src = bands(spark, [0.0, 30.0, 90.0], [1.0, 3.0])
    with pytest.raises(RegridError, match="no destination cell"):
        regrid.regrid(src, bands(spark, [-60.0, -30.0]))
    flat = src.with_df(src.df, dims=DimensionMap(src.dims.axes, src.dims.bounds, Crs("albers", {"lat_1": 29.5, "lat_2": 45.5, "lat_0": 23.0, "lon_0": -96.0})))
    for a, b in ((flat, src), (src, flat)):
        with pytest.raises(RegridError, match="geographic"):
            regrid.regrid(a, b)
    with pytest.raises(DefinitionError):
        Request(simple, regrid_destination=[src, src]).validate()


def test_regrid_over_the_dateline(spark):
    src = Field.of(spark.createDataFrame([(float(x), y, float(x == 350)) for x in range(0, 360, 10) for y in (0.0, 1.0)], "x double, y double, v double"))
    dest = Field.of(spark.createDataFrame([(355.0, 0.5, 0.0)], "x double, y double, v double"))
    assert regrid.regrid(src, dest, "bilinear", cyclic=360.0).df.first().v == pytest.approx(0.5)


def test_nulls_in_weights(spark):
    rows = [(1.0, 1.0, 0.5, 1.5, 0.5, 1.5, 4.0), (2.0, 1.0, 1.5, 2.5, 0.5, 1.5, None)]
    f = Field.of(spark.createDataFrame(rows, "x double, y double, lb_x double, ub_x double, lb_y double, ub_y double, v double"))
    assert spatial.weighted_average(f).df.first().v == 4.0


def test_calendars(spark):
    value = F.col("v")

    def parts(v, units_, calendar):
        return tuple(spark.createDataFrame([(float(v),)], "v double").select(*calendars.date_parts(value, units_, calendar)).first())

    assert parts(59, "days since 2000-01-01", "noleap") == (2000, 3, 1)
    assert parts(59, "days since 2000-01-01", "standard") == (2000, 2, 29)
    assert parts(59, "days since 2001-01-01", "all_leap") == (2001, 2, 29)
    assert parts(59, "days since 2000-01-01", "360_day") == (2000, 2, 30)
    assert parts(365 * 24, "hours since 2000-01-01 00:00:00", "365_day") == (2001, 1, 1)
    assert parts(-1, "days since 2000-01-01", "noleap") == (1999, 12, 31)
    df = spark.createDataFrame([(14.0,)], "v double")
    assert df.select(calendars.months_since(value, "months since 1979-1-1")).first()[0] == datetime(1980, 3, 16)
    assert spark.createDataFrame([(20000301.5,)], "v double").select(calendars.template_days(value)).first()[0] == datetime(2000, 3, 1, 12)
    t = calendars.to_timestamp(value, "days since 1990-01-01 06:00:00")
    assert df.select(calendars.to_number(t, "days since 1990-01-01 06:00:00")).first()[0] == 14.0


def test_netcdf_round_trip(spark, tmp_path, simple):
    f = simple.drop_bounds("time", "level", "x", "y").where("time < timestamp_ntz'2000-03-04 00:00:00'").transform(lambda df: df.withColumn("foo", F.when(F.col("x") > -105, F.col("foo"))))
    path = str(tmp_path / "a.nc")
    sinks.write(f, "nc", path)
    back = Dataset(path, driver_kwargs={"rows": 40}).get(spark)
    assert back.variables == ("foo",) and back.dims.axes["x"] == "x"
    assert back.df.count() == 3 * 2 * 16 and back.df.where("foo is null").count() == 24
    a = f.df.agg(F.sum("foo"), F.sum(F.col("foo") * F.col("x")), F.max("level")).first()
    assert tuple(back.df.agg(F.sum("foo"), F.sum(F.col("foo") * F.col("x")), F.max("level")).first()) == tuple(a)
    assert sorted({r.time for r in back.df.select("time").collect()}) == [11017.5, 11018.5, 11019.5]
    with pytest.raises(ValueError, match="no classic"):
        netcdf.read_header(open(__file__, "rb"))


def test_netcdf_bounds_and_meshes(spark, tmp_path):
    path = str(tmp_path / "b.nc")
    with open(path, "wb") as f:
        netcdf.write(f, {"lat": 2, "nv": 2}, {"lat": (("lat",), np.array([1.0, 2.0]), {"bounds": "lat_b"}), "lat_b": (("lat", "nv"), np.array([[0.5, 1.5], [1.5, 2.5]]), {}), "v": (("lat",), np.array([3, 4], "i4"), {"scale_factor": 0.5})})
    assert [tuple(r) for r in Dataset(path).get(spark).df.orderBy("lat").collect()] == [(1.0, 0.5, 1.5, 1.5), (2.0, 1.5, 2.5, 2.0)]
    ugrid = str(tmp_path / "u.nc")
    with open(ugrid, "wb") as f:
        xs, ys = np.array([0.0, 1.0, 1.0, 0.0, 2.0]), np.array([0.0, 0.0, 1.0, 1.0, 0.5])
        netcdf.write(f, {"node": 5, "face": 2, "four": 4}, {"mesh": ((), np.array(0, "i4"), {"cf_role": "mesh_topology", "node_coordinates": "nx ny", "face_node_connectivity": "fn"}), "nx": (("node",), xs, {}), "ny": (("node",), ys, {}), "fn": (("face", "four"), np.array([[1, 2, 3, 4], [2, 5, 3, -1]], "i4"), {"start_index": 1, "_FillValue": -1})})
    rings = {r.element: [(p.x, p.y) for p in r.ring] for r in mesh.read_mesh(spark, ugrid).collect()}
    assert rings == {0: [(0, 0), (1, 0), (1, 1), (0, 1)], 1: [(1, 0), (2, 0.5), (1, 1)]}
    assert [r.element for r in mesh.subset(mesh.read_mesh(spark, ugrid), 1.5, 0, 3, 1).collect()] == [1]
    esmf = str(tmp_path / "e.nc")
    with open(esmf, "wb") as f:
        netcdf.write(f, {"n": 5, "d": 2, "e": 2, "m": 4}, {"nodeCoords": (("n", "d"), np.column_stack([xs, ys]), {}), "elementConn": (("e", "m"), np.array([[1, 2, 3, 4], [2, 5, 3, 9]], "i4"), {"start_index": 1}), "numElementConn": (("e",), np.array([4, 3], "i4"), {})})
    assert {r.element: [(p.x, p.y) for p in r.ring] for r in mesh.read_mesh(spark, esmf).collect()} == rings
    scrip = str(tmp_path / "s.nc")
    with open(scrip, "wb") as f:
        netcdf.write(f, {"c": 2, "k": 3}, {"grid_corner_lon": (("c", "k"), np.array([[0.0, 1, 1], [2, 3, 3]]), {}), "grid_corner_lat": (("c", "k"), np.array([[0.0, 0, 1], [0, 0, 1]]), {}), "grid_imask": (("c",), np.array([1, 0], "i4"), {})})
    assert [r.element for r in mesh.read_mesh(spark, scrip).collect()] == [0]


def test_mesh_parts_and_reindex(spark):
    faces = spark.createDataFrame([(1, [5, 6, 7, -8, 9, 10]), (2, [7, 9])], "element int, connectivity array<int>")
    assert sorted((r.element, r.part, r.connectivity) for r in mesh.parts(faces, -8).collect()) == [(1, 0, [5, 6, 7]), (1, 1, [9, 10]), (2, 0, [7, 9])]
    nodes = spark.createDataFrame([(k, float(k), 0.0) for k in range(12)], "node int, x double, y double")
    new, linked = mesh.reindex(nodes, spark.createDataFrame([(2, [7, 9])], "element int, connectivity array<int>"))
    assert sorted((r.node, r.x) for r in new.collect()) == [(0, 7.0), (1, 9.0)] and linked.first().connectivity == [0, 1]
    cells = spark.createDataFrame([(1, 0.0, 0.0, [0.0, 1.0], [0.0, 1.0], 1), (2, 0.0, 0.0, [0.0], [0.0], 0)], "cell int, center_x double, center_y double, corners_x array<double>, corners_y array<double>, imask int")
    assert [r.cell for r in mesh.scrip(cells).collect()] == [1]


def test_shapefile_and_cabinet(spark, tmp_path):
    ring = [(0.0, 0.0), (0.0, 2.0), (3.0, 2.0), (3.0, 0.0)]
    sinks.write_shapefile([(ring, {"UGID": 7, "name": "a"}), ([(x + 5, y) for x, y in ring], {"UGID": 9, "name": "b"})], str(tmp_path / "areas.shp"))
    box = Cabinet(str(tmp_path))
    assert box.keys() == ["areas"]
    rows = box.read(spark, "areas").orderBy("ugid").collect()
    assert [(r.ugid, r.x0, r.y0, r.x1, r.y1, r.properties["NAME"]) for r in rows] == [(7, 0, 0, 3, 2, "a"), (9, 5, 0, 8, 2, "b")]
    assert [r.ugid for r in box.read(spark, "areas", select_sql_where="properties['NAME'] = 'b'").collect()] == [9]
    assert [r.ugid for r in box.read(spark, "areas", [7]).collect()] == [7]
    with pytest.raises(DefinitionError):
        box.read(spark, "none")


def test_geojson_round_trip(spark, tmp_path, simple):
    one = simple.where("level = 50 and time = timestamp_ntz'2000-03-01 12:00:00'")
    path = tmp_path / "c.geojson"
    path.write_text(sinks.geojson_collection(one))
    back = Dataset(str(path), variable=[]).frame(spark)
    assert back.count() == 16 and back.where("geom_type = 'Polygon' and size(ring) = 5").count() == 16
    assert Cabinet(str(tmp_path)).read(spark, "c").agg(F.min("x0"), F.max("x1")).first() == (-105.5, -101.5)


def test_csv_round_trip(spark, tmp_path, simple):
    one = simple.where("level = 50 and time = timestamp_ntz'2000-03-01 12:00:00'")
    paths = Request(one, output_format="csv", dir_output=str(tmp_path), melted=True, add_auxiliary_files=True).execute(spark)
    back = Dataset(paths[0], driver="csv").frame(spark)
    assert set(back.dtypes) >= {("VARIABLE", "string"), ("VALUE", "string"), ("TIME", "string")} and back.count() == 16
    assert spark.read.csv(str(tmp_path / "isobar_output_did"), header=True).first().VARIABLE == "foo"
    sinks.write(one, "csv-shp", str(tmp_path / "d"))
    assert spark.read.csv(str(tmp_path / "d_gid"), header=True).count() == 16
    sinks.write(one, "meta-json", str(tmp_path / "m.json"))
    assert json.loads((tmp_path / "m.json").read_text())["name"] == "field"


def test_drivers():
    assert driver_for(["a.parquet"]).key == "parquet" and driver_for(["a.geojson"]).key == "vector" and driver_for(["x"], "netcdf").key == "netcdf"
    with pytest.raises(DefinitionError):
        driver_for(["a.unknown"])


def test_metadata_alone(spark):
    f = Dataset(None, schema="time timestamp_ntz, lat double, lon double, tas double").get(spark)
    assert f.variables == ("tas",) and f.dims.axes["x"] == "lon" and f.df.isEmpty()


def test_axis_attributes(spark):
    df = spark.range(1).select(F.lit(1.0).alias("a", metadata={"axis": "X"}), F.lit(2.0).alias("b"))
    assert DimensionMap.detect(df).axes == {"x": "a"}


def test_stream(spark, tmp_path, simple):
    simple.df.select("time", "x", "y", "foo").repartition(3).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("time timestamp_ntz, x double, y double, foo double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    made = windowed(Field.of(source, ("foo",)), ["mean", "max"], "1 day")
    rows = run_to_table(made, str(tmp_path / "out"), str(tmp_path / "cp"), "complete").collect()
    assert len(rows) == 61 * 16 and {r["mean"] for r in rows} == {1.0, 2.0, 3.0, 4.0}
    closed = run_to_table(made, str(tmp_path / "out2"), str(tmp_path / "cp2")).collect()
    assert set(closed) < set(rows) and len(closed) >= 58 * 16  # the last days wait for the watermark
    with pytest.raises(DefinitionError):
        windowed(Field.of(source, ("foo",)), "duration!threshold~1!operation~gt")


def test_plan_reads_what_it_needs(spark):
    f = Dataset("/root/testdata/sf0.001/lineitem.parquet", variable="quantity", columns={"time": "l_shipdate", "x": "l_suppkey", "quantity": "l_quantity"}, time_range=(datetime(1996, 1, 1), datetime(1996, 2, 1))).get(spark)
    plan = calculate(f, "mean", ["month"]).df._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "FileScan" in x)
    assert "GreaterThanOrEqual(l_shipdate" in scan and "ReadSchema: struct<l_suppkey:bigint,l_quantity:double,l_shipdate:timestamp_ntz>" in scan
    assert plan.count("Exchange hashpartitioning") == 1
