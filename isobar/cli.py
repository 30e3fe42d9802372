"""Command line: regridding weights by chunks, and their application."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from isobar.operators import regrid
from isobar.sources.datasets import Dataset


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="isobar")
    steps = parser.add_subparsers(dest="step", required=True)
    chunked = steps.add_parser("chunked-rwg", help="write weights, partitioned by destination tile")
    applied = steps.add_parser("chunked-smm", help="apply weights to a source")
    for p in (chunked, applied):
        p.add_argument("--source", required=True)
        p.add_argument("--weights", required=True)
    chunked.add_argument("--destination", required=True)
    chunked.add_argument("--tile", type=float, default=10.0)
    chunked.add_argument("--method", default="auto", choices=("auto", "conserve", "bilinear", "nearest"))
    applied.add_argument("--output", required=True)
    a = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    source = Dataset(a.source).get(spark)
    if a.step == "chunked-rwg":
        regrid.chunked_weights(source, Dataset(a.destination).get(spark), a.tile, a.method).write.partitionBy("tile_x", "tile_y").parquet(a.weights)
    else:
        regrid.apply_weights(source, spark.read.parquet(a.weights).drop("tile_x", "tile_y")).df.write.parquet(a.output)


if __name__ == "__main__":
    main()
