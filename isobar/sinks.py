"""Tabular output and writers."""

from __future__ import annotations

import os
import struct
from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobar.errors import DefinitionError
from isobar.model import Field
from isobar.sources import netcdf
from isobar.sources.datasets import meta_json

#: The order of columns in tabular output.
HEADER = ("DID", "UGID", "GID", "RLZ", "TIME", "LB_TIME", "UB_TIME", "YEAR", "MONTH", "DAY", "LEVEL", "LB_LEVEL", "UB_LEVEL", "VARIABLE", "VALUE", "CALC_KEY", "SRC_VAR")


def tabular(f: Field, melted: bool = False, calc_keys: dict[str, str] | None = None, sources: dict[str, str] | None = None) -> DataFrame:
    """Rows with standard headings: flat, one column per variable, or melted to VARIABLE and VALUE."""
    df = f.df
    if f.has("geom") or "GID" in df.columns or "gid" in df.columns:
        key = "GID" if "GID" in df.columns else "gid" if "gid" in df.columns else f.dims.column("geom")
        df = df.where(F.col(key).isNotNull())
    names = {"UGID": "UGID", "gid": "GID", "GID": "GID", "realization": "RLZ", "time": "TIME", "level": "LEVEL"}
    cols = {"DID": F.lit(f.did)}
    for axis in ("realization", "time", "level"):
        if f.has(axis):
            cols[names[axis]] = f.axis(axis)
            for side, c in zip(("LB_", "UB_"), f.bounds(axis) or (), strict=False):
                cols[side + names[axis]] = F.col(c)
    if f.has("time"):
        t = f.axis("time")
        cols |= {"YEAR": F.year(t), "MONTH": F.month(t), "DAY": F.dayofmonth(t)}
    cols |= {names[c]: F.col(c) for c in ("UGID", "gid", "GID") if c in df.columns}
    if "GID" not in cols and f.has("x") and f.has("y"):
        cols |= {"X": f.axis("x"), "Y": f.axis("y")}
    order = [*(c for c in HEADER if c in cols), *(c for c in cols if c not in HEADER)]
    flat = df.select(*(cols[c].alias(c) for c in order), *f.variables)
    if not melted:
        return flat
    kinds = dict(flat.dtypes)
    out = flat.withColumns({v: F.col(v).cast("double") for v in f.variables if kinds[v] != "double"}).unpivot(order, list(f.variables), "VARIABLE", "VALUE")
    for name, table in (("CALC_KEY", calc_keys), ("SRC_VAR", sources)):
        if table:
            out = out.withColumn(name, F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[F.col("VARIABLE")])
    return out


def did_table(spark: Any, fields: list[Field], uris: list[str]) -> DataFrame:
    rows = [(f.did, v, f.attrs.get("standard_name"), f.attrs.get("long_name"), f.units.get(v), uri, f.attrs.get("group")) for f, uri in zip(fields, uris, strict=True) for v in f.variables]
    return spark.createDataFrame(rows, "DID int, VARIABLE string, STANDARD_NAME string, LONG_NAME string, UNITS string, URI string, GROUP string")


def geojson(f: Field) -> DataFrame:
    """(value): one feature a row, with its cell's polygon or point and all else as properties."""
    from isobar.operators.spatial import corners

    if f.bounds("x") and f.bounds("y"):
        shape = F.transform(F.concat(corners(f), F.slice(corners(f), 1, 1)), lambda p: F.array(p.x, p.y))
        geometry = F.struct(F.lit("Polygon").alias("type"), F.array(shape).alias("coordinates"))
    else:
        geometry = F.struct(F.lit("Point").alias("type"), F.array(f.axis("x").cast("double"), f.axis("y").cast("double")).alias("coordinates"))
    gone = {f.dims.column("x"), f.dims.column("y"), *(f.bounds("x") or ()), *(f.bounds("y") or ())}
    properties = F.struct(*(F.col(c) for c in f.df.columns if c not in gone))
    return f.df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties"))).alias("value"))


def write_geojson(f: Field, path: str) -> None:
    """Features line by line, written in parallel; wrap_geojson makes one collection of a small result."""
    geojson(f).write.text(path)


def geojson_collection(f: Field) -> str:
    return '{"type":"FeatureCollection","features":[' + ",".join(r.value for r in geojson(f).toLocalIterator()) + "]}"


def write_netcdf(f: Field, path: str) -> None:
    """A classic NetCDF file of a result that is a full grid. The file format is one array, so rows come to the driver one by one."""
    axes = [f.dims.column(a) for a in ("realization", "time", "level", "y", "x") if f.has(a)]
    kinds = dict(f.df.dtypes)
    as_number = {c: (F.unix_seconds(F.col(c).cast("timestamp")) / 86400.0 if "timestamp" in kinds[c] else F.col(c).cast("double")) for c in axes}
    coords = {c: [r[0] for r in f.df.select(as_number[c].alias(c)).distinct().orderBy(c).collect()] for c in axes}
    place = {c: {v: k for k, v in enumerate(values)} for c, values in coords.items()}
    arrays = {v: np.full(tuple(len(coords[c]) for c in axes), 1e20) for v in f.variables}
    for r in f.df.select(*(as_number[c].alias(c) for c in axes), *f.variables).toLocalIterator():
        at = tuple(place[c][r[c]] for c in axes)
        for v in f.variables:
            if r[v] is not None:
                arrays[v][at] = r[v]
    time = f.dims.axes.get("time")
    made = {c: ((c,), np.array(values), {"units": "days since 1970-01-01", "axis": "T"} if c == time else {}) for c, values in coords.items()}
    made |= {v: (tuple(axes), a, {"_FillValue": 1e20, **({"units": f.units[v]} if f.units.get(v) else {})}) for v, a in arrays.items()}
    with open(path, "wb") as out:
        netcdf.write(out, {c: len(v) for c, v in coords.items()}, made, {"Conventions": "CF-1.6"})


def write_shapefile(records: list[tuple[list[tuple[float, float] | None], dict[str, Any]]], path: str) -> None:
    """Polygons, with parts that nulls end, and their properties as .shp, .shx and .dbf: for selection geometries and other small results."""
    from isobar.operators.spatial import parts

    points = [[p for p in r if p] for r, _ in records]
    boxes = [(min(x for x, _ in r), min(y for _, y in r), max(x for x, _ in r), max(y for _, y in r)) for r in points]
    shapes, offsets, at = [], [], 50
    for k, ((ring, _), box) in enumerate(zip(records, boxes, strict=True), 1):
        rings = [r if r[0] == r[-1] else [*r, r[0]] for r in parts(ring)]
        starts = [sum(map(len, rings[:n])) for n in range(len(rings))]
        body = struct.pack(f"<i4d2i{len(rings)}i", 5, *box, len(rings), sum(map(len, rings)), *starts) + b"".join(struct.pack("<2d", *p) for r in rings for p in r)
        shapes.append(struct.pack(">2i", k, len(body) // 2) + body)
        offsets.append(struct.pack(">2i", at, len(body) // 2))
        at += len(body) // 2 + 4
    whole = (min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)) if boxes else (0.0,) * 4
    head = lambda words: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<2i8d", 1000, 5, *whole, 0, 0, 0, 0)
    stem = path.removesuffix(".shp")
    with open(stem + ".shp", "wb") as f:
        f.write(head(at) + b"".join(shapes))
    with open(stem + ".shx", "wb") as f:
        f.write(head(50 + 4 * len(records)) + b"".join(offsets))
    names = list(records[0][1]) if records else ["UGID"]
    with open(stem + ".dbf", "wb") as f:
        f.write(struct.pack("<4B I 2H 20x", 3, 100, 1, 1, len(records), 33 + 32 * len(names), 1 + 64 * len(names)))
        f.write(b"".join(n[:10].upper().encode().ljust(11, b"\0") + struct.pack("<c4xBB14x", b"C", 64, 0) for n in names) + b"\r")
        for _, props in records:
            f.write(b" " + b"".join(str(props.get(n, "")).encode()[:64].ljust(64) for n in names))
        f.write(b"\x1a")


def write_csv(f: Field, path: str, **options: Any) -> None:
    tabular(f, **options).write.csv(path, header=True)


def write_csv_shp(f: Field, path: str, **options: Any) -> None:
    """Values as CSV, and the cells' boxes as a table beside them."""
    write_csv(f, path, **options)
    if f.bounds("x") and f.bounds("y"):
        f.df.select(f.dims.column("x"), f.dims.column("y"), *f.bounds("x"), *f.bounds("y")).distinct().write.csv(path.rstrip("/") + "_gid", header=True)


def write_meta(f: Field, path: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        out.write(meta_json(f))


WRITERS: dict[str, Callable[..., Any]] = {
    "csv": write_csv,
    "csv-shp": write_csv_shp,
    "geojson": write_geojson,
    "nc": write_netcdf,
    "meta-json": write_meta,
    "meta-text": lambda f, path: open(path, "w").write(f.describe()),
    "parquet": lambda f, path, mode="errorifexists": f.df.write.mode(mode).parquet(path),
    "shp": lambda f, path: write_shapefile([([(r.x0, r.y0), (r.x0, r.y1), (r.x1, r.y1), (r.x1, r.y0)], {"GID": k}) for k, r in enumerate(boxes(f).collect(), 1)], path),
}


def boxes(f: Field) -> DataFrame:
    from isobar.operators.spatial import edges

    x0, y0, x1, y1 = edges(f)
    return f.df.select(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")).distinct().orderBy("y0", "x0")


def write(f: Field, output_format: str, path: str, **options: Any) -> None:
    if output_format not in WRITERS:
        raise DefinitionError(f"output_format {output_format}")
    WRITERS[output_format](f, path, **options)

