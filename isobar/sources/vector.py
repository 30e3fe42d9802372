"""Shapefiles and geometry cabinets: selection geometries from files."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.errors import DefinitionError
from isobar.operators.spatial import RING, select_uid, together, with_uid


def shapes(raw: bytes) -> Iterator[list[tuple[float, float] | None] | None]:
    """The ring of each polygon with all its parts and holes, or a point's place; null shapes are None."""
    at = 100
    while at + 8 <= len(raw):
        size = 2 * struct.unpack_from(">i", raw, at + 4)[0]
        kind = struct.unpack_from("<i", raw, at + 8)[0] % 10
        if kind == 1:
            yield [struct.unpack_from("<2d", raw, at + 12)]
        elif kind in (3, 5):
            count, points = struct.unpack_from("<2i", raw, at + 44)
            starts = [*struct.unpack_from(f"<{count}i", raw, at + 52), points]
            flat = struct.unpack_from(f"<{2 * points}d", raw, at + 52 + 4 * count)
            line = list(zip(flat[::2], flat[1::2], strict=True))
            rings = [r[:-1] if len(r) > 1 and r[0] == r[-1] else r for r in (line[a:b] for a, b in zip(starts, starts[1:], strict=False)) if r]
            yield together(rings) if rings else None
        else:
            yield None
        at += 8 + size


def attributes(raw: bytes) -> list[dict[str, str]]:
    """Records of a dBASE table, as text."""
    rows, head, size = struct.unpack_from("<I2H", raw, 4)
    names, at = [], 32
    while raw[at] != 0x0D:
        names.append((raw[at : at + 11].split(b"\0")[0].decode(), raw[at + 16]))
        at += 32
    out = []
    for k in range(rows):
        place, row = head + k * size + 1, {}
        for name, width in names:
            row[name] = raw[place : place + width].decode("utf-8", "replace").strip()
            place += width
        out.append(row)
    return out


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """(ugid, x0, y0, x1, y1, ring, properties) of a shapefile. The files are read by Spark, the pair of them in one task."""
    stem = path.removesuffix(".shp")
    both = spark.read.format("binaryFile").load([stem + ".shp", stem + ".dbf"]).select(F.right("path", F.lit(3)).alias("kind"), "content")
    one = both.groupBy(F.lit(1).alias("k")).agg(F.max_by("content", F.col("kind") == "shp").alias("shp"), F.max_by("content", F.col("kind") == "dbf").alias("dbf"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shp, dbf in zip(batch["shp"], batch["dbf"], strict=True):
                rows = []
                for k, (ring, props) in enumerate(zip(shapes(shp), attributes(dbf), strict=True), 1):
                    if ring is not None:
                        xs, ys = zip(*(p for p in ring if p), strict=True)
                        uid = props.get("UGID", "")
                        rows.append((int(float(uid)) if uid else k, min(xs), min(ys), max(xs), max(ys), [p and {"x": p[0], "y": p[1]} for p in ring] if len(ring) > 2 else None, props))
                yield pd.DataFrame(rows, columns=["ugid", "x0", "y0", "x1", "y1", "ring", "properties"])

    return one.select("shp", "dbf").mapInPandas(run, f"ugid int, x0 double, y0 double, x1 double, y1 double, ring {RING}, properties map<string,string>")


class Cabinet:
    """A folder of selection geometries by name: shapefiles, GeoJSON or Parquet."""

    def __init__(self, path: str):
        self.path = path

    def keys(self) -> list[str]:
        return sorted({os.path.splitext(n)[0] for n in os.listdir(self.path) if n.endswith((".shp", ".geojson", ".parquet"))})

    def read(self, spark: SparkSession, key: str, select_uid_: list[int] | None = None, select_sql_where: str | None = None, uid: str | None = None) -> DataFrame:
        from isobar.sources.datasets import read_geojson

        stem = os.path.join(self.path, key)
        if os.path.exists(stem + ".shp"):
            df = read_shapefile(spark, stem + ".shp")
        elif os.path.exists(stem + ".geojson"):
            raw = read_geojson(spark, [stem + ".geojson"], {})
            edge = lambda f, axis: f(F.transform("ring", lambda p: p[axis]))
            df = raw.where("ring is not null").select(F.col("gid").cast("int").alias("ugid"), edge(F.array_min, "x").alias("x0"), edge(F.array_min, "y").alias("y0"), edge(F.array_max, "x").alias("x1"), edge(F.array_max, "y").alias("y1"), "ring", "properties")
        elif os.path.exists(stem + ".parquet"):
            df = spark.read.parquet(stem + ".parquet")
        else:
            raise DefinitionError(f"no geometry {key} in {self.path}")
        if uid:
            df = df.withColumn("ugid", F.col("properties")[uid].cast("int")) if uid not in df.columns else with_uid(df, uid)
        if select_sql_where:
            df = df.where(select_sql_where)
        return select_uid(df, select_uid_) if select_uid_ else df
