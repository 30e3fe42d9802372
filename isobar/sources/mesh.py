"""Unstructured meshes: elements and nodes as tables, from connectivity, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def elements(nodes: DataFrame, faces: DataFrame, start_index: int = 0) -> DataFrame:
    """(element, ring) from nodes (node, x, y) and faces (element, connectivity array of node numbers); fill values are below the start."""
    sides = faces.select("element", F.posexplode("connectivity").alias("place", "node")).where(F.col("node") >= start_index)
    met = sides.withColumn("node", F.col("node") - start_index).join(nodes.select("node", "x", "y"), "node")
    ring = F.transform(F.array_sort(F.collect_list(F.struct("place", "x", "y"))), lambda p: F.struct(p.x.alias("x"), p.y.alias("y")))
    return met.groupBy("element").agg(ring.alias("ring"))


def parts(faces: DataFrame, break_value: int) -> DataFrame:
    """(element, part, connectivity): elements of several parts, which a break value divides."""
    sides = faces.select("element", F.posexplode("connectivity").alias("place", "node"))
    w = W.partitionBy("element").orderBy("place")
    split = sides.withColumn("part", F.sum(F.when(F.col("node") == break_value, 1).otherwise(0)).over(w)).where(F.col("node") != break_value)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "node"))), lambda p: p.node)
    return split.groupBy("element", "part").agg(ordered.alias("connectivity"))


def scrip(cells: DataFrame) -> DataFrame:
    """(cell, x, y, ring) of SCRIP cells (cell, center_x, center_y, corners_x, corners_y, imask); masked cells go."""
    ring = F.arrays_zip(F.col("corners_x").alias("x"), F.col("corners_y").alias("y"))
    return cells.where("imask <> 0").select("cell", F.col("center_x").alias("x"), F.col("center_y").alias("y"), ring.alias("ring"))


def reindex(nodes: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes that faces still use, numbered from 0 in their old order, and the faces with the new numbers."""
    sides = faces.select("element", F.posexplode("connectivity").alias("place", "node"))
    used = sides.select("node").distinct().withColumn("new", F.row_number().over(W.orderBy("node")) - 1)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", F.col("new").alias("node")))), lambda p: p.node)
    return nodes.join(used, "node").select(F.col("new").alias("node"), "x", "y"), sides.join(used, "node").groupBy("element").agg(ordered.alias("connectivity"))


def connectivity(elements_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, faces) of elements' rings: equal points are one node."""
    points = elements_.select("element", F.posexplode("ring").alias("place", "p")).select("element", "place", "p.x", "p.y")
    nodes = points.select("x", "y").distinct().withColumn("node", F.row_number().over(W.orderBy("x", "y")) - 1)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "node"))), lambda p: p.node)
    return nodes.select("node", "x", "y"), points.join(nodes, ["x", "y"]).groupBy("element").agg(ordered.alias("connectivity"))


def read_mesh(spark, path: str) -> DataFrame:
    """(element, ring) of a mesh in a classic NetCDF file: UGRID (by cf_role), SCRIP or ESMF by their variables' names.

    Connectivity and coordinates are read once by the driver, whose arrays become tables.
    """
    import numpy as np
    import pandas as pd

    from isobar.sources import netcdf

    with open(path, "rb") as f:
        h = netcdf.read_header(f)
        get = lambda name: netcdf.read_variable(f, h, name)
        found = {v.attrs.get("cf_role"): v for v in h.variables.values() if "cf_role" in v.attrs}
        if "mesh_topology" in found:
            top = found["mesh_topology"].attrs
            x, y = (get(n) for n in top["node_coordinates"].split())
            faces = top["face_node_connectivity"]
            start, links, counts = int(h.variables[faces].attrs.get("start_index", 0)), get(faces), None
        elif "elementConn" in h.variables:
            nodes = get("nodeCoords")
            x, y, start = nodes[:, 0], nodes[:, 1], int(h.variables["elementConn"].attrs.get("start_index", 1))
            links, counts = get("elementConn"), get("numElementConn") if "numElementConn" in h.variables else None
        elif "grid_corner_lon" in h.variables:
            x, y = get("grid_corner_lon"), get("grid_corner_lat")
            if "imask" in str(sorted(h.variables)):
                kept = get("grid_imask") != 0
                ids, x, y = np.flatnonzero(kept), x[kept], y[kept]
            else:
                ids = np.arange(len(x))
            rows = pd.DataFrame({"element": ids.astype(np.int64), "ring": [[{"x": float(a), "y": float(b)} for a, b in zip(p, q, strict=True)] for p, q in zip(x, y, strict=True)]})
            return spark.createDataFrame(rows, "element long, ring array<struct<x:double,y:double>>")
        else:
            raise ValueError("no mesh of a known kind")
    links = np.where(np.isnan(links.astype(float)), start - 1, links).astype(np.int64)
    if counts is not None:
        links = np.where(np.arange(links.shape[1]) < counts[:, None], links, start - 1)
    node_table = spark.createDataFrame(pd.DataFrame({"node": np.arange(len(x)), "x": np.asarray(x, float), "y": np.asarray(y, float)}), "node long, x double, y double")
    face_table = spark.createDataFrame(pd.DataFrame({"element": np.arange(len(links)), "connectivity": links.tolist()}), "element long, connectivity array<long>")
    return elements(node_table, face_table, start)


def subset(elements_: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Elements that meet a box, touches included; the others go."""
    edge = lambda f, axis: f(F.transform("ring", lambda p: p[axis]))
    return elements_.where((edge(F.array_min, "x") <= x1) & (edge(F.array_max, "x") >= x0) & (edge(F.array_min, "y") <= y1) & (edge(F.array_max, "y") >= y0))
