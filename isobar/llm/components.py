"""Connected components of links, distributed: large star and small star in turn until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobar.llm.base import removed, written


def signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(id, component) for each id in links (a, b); component is the smallest id reachable. Ids may be structs.

    Edges point from larger to smaller ids. The large star joins each node's larger neighbours to its least neighbour, the
    small star its smaller ones; the edges end as stars around the least ids. Only edges move, never whole components.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = signature(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("u", "least"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("least"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("least").alias("v")), F.struct(F.col("v").alias("u"), F.col("least").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        new = written(small, "edges")
        removed(edges)
        edges, after = new, signature(new)
        if after == before:
            break
        before = after
    return edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component").unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
