"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the map that screened() broadcasts (8 MB), whatever the table; bytes of its pieces; bytes of Spark's bitmaps (fixed value).
BITS, PIECE, PART = 1 << 26, 64, 4096
#: Rows that a Python worker handles at once; a slice of whole texts stays small beside the JVM's batch.
SLICE = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of few rows, for rows that hold whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


#: What workers forget at the end of a task.
FORGET: list[Callable[[], None]] = []


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    trim()


def trim() -> None:
    """Gives memory back: a worker that waits for its next task shares its executor with others."""
    for forget in FORGET:
        forget()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def screened(rows: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """rows with __maybe: false where the columns on are certainly those of no row of wanted, none of them null.

    So rows can be left out before a shuffle. What is broadcast is a map of BITS bits at hashed places, in pieces of PIECE
    bytes, those without any bit left out. Keys by the hundred million fill it; then all rows pass, and the join that follows
    does the same work as without it.
    """
    place = F.pmod(F.xxhash64(*on), F.lit(BITS))
    found = wanted.select((place + 1).alias("__place"))
    bits = found.groupBy(F.bitmap_bucket_number("__place").alias("__part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__place")).alias("__bits"))
    pieces = bits.select("__part", "__bits", F.explode(F.sequence(F.lit(0), F.lit(PART // PIECE - 1))).alias("__k"))
    number = (F.col("__part") - 1) * (PART // PIECE) + F.col("__k")
    held = pieces.select(number.alias("__piece"), F.substring("__bits", F.col("__k") * PIECE + 1, F.lit(PIECE)).alias("__bits")).where(F.col("__bits") != F.lit(bytes(PIECE)))
    at = F.pmod("__place", F.lit(8 * PIECE)).cast("int")
    byte = F.conv(F.hex(F.substring("__bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    there = F.call_function("shiftright", byte, F.pmod(at, F.lit(8))).bitwiseAND(1) == 1
    asked = rows.withColumn("__place", place).withColumn("__piece", F.floor(F.col("__place") / (8 * PIECE)))
    return asked.join(F.broadcast(held), "__piece", "left").withColumn("__maybe", F.coalesce(there, F.lit(False))).drop("__place", "__piece", "__bits")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir); removed when the application ends.

    Without that setting a local session takes a temporary folder; a cluster, whose executors don't share one, an error.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="isobar-")
        spark.conf.set("spark.checkpoint.dir", top)
    path = f"{top.rstrip('/')}/isobar-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends here and it outlives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Deletes the files of a table made by written(), once nothing reads it any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/isobar-" in path:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
