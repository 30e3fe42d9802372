"""Calculations over streams: the set functions in event-time windows, with late data bounded by a watermark."""

from __future__ import annotations

import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.errors import DefinitionError
from isobar.functions import library
from isobar.model import Field
from isobar.plans.calculate import named, parse_calc


def windowed(f: Field, calc: Any, window: str = "1 day", delay: str = "1 day", slide: str | None = None) -> DataFrame:
    """One row per cell and window for set calculations over a streaming, or any, field: median and percentile are exact and
    keep a window's values as state, the others a few numbers."""
    time = f.dims.column("time")
    df = f.df.withColumn(time, F.col(time).cast("timestamp"))
    if df.isStreaming:
        df = df.withWatermark(time, delay)
    made = []
    for x in parse_calc(calc):
        of = library.lookup(x["func"])
        if of.kind != "set":
            raise DefinitionError(f"{x['func']} has no streaming form")
        made += [of.build(F.col(v), **of.checked(x["kwds"])).alias(named(x["name"], v, f)) for v in f.variables]
    spans = F.window(time, window, slide) if slide else F.window(time, window)
    out = df.groupBy(spans.alias("w"), *f.keys).agg(*made)
    return out.select(F.col("w.start").alias("lb_time"), F.col("w.end").alias("ub_time"), *[c for c in out.columns if c != "w"])


def folder(spark: SparkSession, name: str) -> str:
    """A new path for a stream's state or result, in the folder that all executors share (spark.checkpoint.dir)."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise DefinitionError("spark.checkpoint.dir has to name a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="isobar-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def run_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a streaming query over what its source has now, into a Parquet table, which is read again.

    append adds windows as the watermark closes them; complete writes all windows anew with each batch.
    """
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "complete":
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path))
    else:
        writer = writer.format("parquet").option("path", path)
    writer.start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)
