"""Media columns: PNG and perceptual hashes [operator 9].

Method: binary columns hold PNG files. They are taken apart chunk by chunk with checksum tests, inflated by zlib and
unfiltered by numpy; features are hashes of the lowest frequencies of a cosine transform.

A payload is bytes of 8-bit RGB rows of WIDTH pixels: texts are padded with spaces to a positive multiple of 192.
Null and empty texts give one row of spaces. Rows are independent: equal texts give equal files and features, null
ids are kept, an empty table gives no rows, and other columns are not read. A damaged file raises ValueError.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.llm.base import bounded_batches, slices, table

WIDTH, CHANNELS = 64, 3
ROW = WIDTH * CHANNELS
#: Fixed value: the first bytes of the format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
IDAT = 1 << 16
SIDE, KEPT = 32, 8


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(1, -(-len(raw) // ROW)) * ROW, b" ")


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def write_png(payload: bytes, level: int = 1) -> bytes:
    """RGB rows of WIDTH pixels. Each row holds the differences to the row above (filter 2)."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.empty((len(rows), ROW + 1), np.uint8)
    lines[:, 0] = 2
    lines[0, 1:] = rows[0]
    np.subtract(rows[1:], rows[:-1], out=lines[1:, 1:])
    packed = zlib.compress(lines.tobytes(), level)
    parts = [SIGNATURE, chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0))]
    parts += [chunk(b"IDAT", packed[k : k + IDAT]) for k in range(0, len(packed), IDAT)]
    return b"".join([*parts, chunk(b"IEND", b"")])


def unfiltered(lines: np.ndarray, channels: int) -> np.ndarray:
    """Rows of samples from rows that begin with their filter. Runs of rows of one filter that numpy can sum go at once."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    n, k, width = len(out), 0, out.shape[1]
    if n and kinds.max() > 4:
        raise ValueError("unknown PNG filter")
    ends = [*(np.flatnonzero(np.diff(kinds)) + 1), n]
    for end in ends:
        kind, block = kinds[k], out[k:end]
        above = out[k - 1] if k else np.zeros(width, np.uint8)
        if kind == 1:
            pixels = block.reshape(end - k, -1, channels)
            np.cumsum(pixels, axis=1, dtype=np.uint8, out=pixels)
        elif kind == 2:
            block[0] += above
            np.cumsum(block, axis=0, dtype=np.uint8, out=block)
        elif kind > 2:
            for row in block:
                up, left, corner = above.reshape(-1, channels).astype(int), np.zeros(channels, int), np.zeros(channels, int)
                for pixel, b in zip(row.reshape(-1, channels), up, strict=True):
                    if kind == 3:
                        guess = (left + b) // 2
                    else:
                        pa_, pb, pc = np.abs(b - corner), np.abs(left - corner), np.abs(left + b - 2 * corner)
                        guess = np.where((pa_ <= pb) & (pa_ <= pc), left, np.where(pb <= pc, b, corner))
                    pixel += guess.astype(np.uint8)
                    left, corner = pixel.astype(int), b
                above = row
        k = end
    return out


def read_png(data: bytes) -> np.ndarray:
    """(height, width, channels) 8-bit samples of a PNG in grey, grey and alpha, RGB or RGBA."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, packed, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("PNG cut off")
        (size,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError("PNG checksum differs")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    channels = {0: 1, 4: 2, 2: 3, 6: 4}.get(head[3] if head else -1)
    if not ended or not channels or head[2] != 8 or head[6]:
        raise ValueError("PNG of another kind")
    width, height = head[:2]
    size, inflate = height * (width * channels + 1), zlib.decompressobj()
    try:
        raw = inflate.decompress(b"".join(packed), size + 1)  # no more than the header tells, whatever the data say
    except zlib.error as e:
        raise ValueError("PNG data broken") from e
    if len(raw) != size or not inflate.eof:
        raise ValueError("PNG of another size")
    lines = np.frombuffer(raw, np.uint8).reshape(height, -1)
    return unfiltered(lines, channels).reshape(height, width, channels)


@lru_cache(maxsize=1)
def cosines() -> np.ndarray:
    k, x = np.arange(KEPT)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * SIDE))


def shrunk(values: np.ndarray, axis: int) -> np.ndarray:
    """SIDE means along an axis; shorter axes repeat their samples."""
    n = values.shape[axis]
    if n < SIDE:
        return np.take(values, np.arange(SIDE) * n // SIDE, axis)
    edges = np.arange(SIDE + 1) * n // SIDE
    counts = np.diff(edges).reshape((-1, 1) if axis == 0 else (1, -1))
    return np.add.reduceat(values, edges[:-1], axis) / counts


def feature(pixels: np.ndarray) -> str:
    """16 hex digits: which of the lowest 8 by 8 frequencies lie above their median."""
    grey = pixels.sum(axis=2, dtype=np.float64)
    small = shrunk(shrunk(grey, 0), 1)
    low = np.round(cosines() @ small @ cosines().T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text as the bytes of a PNG file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [padded(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([write_png(p) for _, p in made], pa.binary())], names=[id_col, "n_bytes", "media"])

    kind = df.select(F.col(id_col)).schema[0].dataType.simpleString()
    return df.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary")


def read(df: DataFrame, media_col: str = "media") -> DataFrame:
    """df with payload (the samples in order) and feature of each file; both null where the file is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            pixels = [read_png(x.as_py()) if x.is_valid else None for x in batch.column(media_col)]
            payload = pa.array([None if x is None else x.tobytes() for x in pixels], pa.binary())
            hashes = pa.array([None if x is None else feature(x) for x in pixels], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, payload, hashes], names=[*batch.schema.names, "payload", "feature"])

    columns = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema)
    return df.mapInArrow(run, f"{columns}, payload binary, feature string")


def digests(df: DataFrame) -> DataFrame:
    return read(store(df)).select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).cast("long").alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return digests(table(spark, sf_dir, "documents"))
