"""Classic NetCDF (CDF-1 and CDF-2) as a Spark data source, read and written without other libraries.

The header tells each variable's shape and place; partitions are ranges of the leading dimension, and each reads only its
own bytes of the variables asked for. Rows are the cells of one variable group, in long form.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any, BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The format's type codes, numpy types and tags.
KINDS = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12


@dataclass
class Variable:
    name: str
    dims: tuple[str, ...]
    kind: str
    attrs: dict[str, Any]
    begin: int = 0
    record: bool = False


@dataclass
class Header:
    dims: dict[str, int]
    attrs: dict[str, Any]
    variables: dict[str, Variable]
    records: int = 0
    record_size: int = 0
    unlimited: str | None = None
    extra: dict = field(default_factory=dict)


def padded(n: int) -> int:
    return -(-n // 4) * 4


def read_header(f: BinaryIO) -> Header:
    if f.read(3) != b"CDF" or (version := f.read(1)[0]) not in (1, 2):
        raise ValueError("no classic NetCDF file")
    number = lambda: struct.unpack(">i", f.read(4))[0]

    def name() -> str:
        n = number()
        return f.read(padded(n))[:n].decode()

    def attributes() -> dict[str, Any]:
        _, out = number(), {}
        for _ in range(number()):
            key, kind, n = name(), number(), number()
            raw = f.read(padded(n * np.dtype(KINDS[kind]).itemsize))
            values = np.frombuffer(raw, KINDS[kind], n)
            out[key] = values.tobytes().decode("utf-8", "replace") if kind == 2 else values.item() if n == 1 else values.tolist()
        return out

    records = number()
    number()
    sizes = [(name(), number()) for _ in range(number())]
    unlimited = next((k for k, n in sizes if n == 0), None)
    dims = {k: n or records for k, n in sizes}
    attrs = attributes()
    number()
    found = {}
    for _ in range(number()):
        key = name()
        of = tuple(sizes[number()][0] for _ in range(number()))
        own = attributes()
        kind, _ = number(), number()
        begin = struct.unpack(">i" if version == 1 else ">q", f.read(4 if version == 1 else 8))[0]
        found[key] = Variable(key, of, KINDS[kind], own, begin, bool(of) and of[0] == unlimited)
    slabs = [math.prod(dims[d] for d in v.dims[1:]) * np.dtype(v.kind).itemsize for v in found.values() if v.record]
    return Header(dims, attrs, found, records, slabs[0] if len(slabs) == 1 else sum(map(padded, slabs)), unlimited)


def read_variable(f: BinaryIO, h: Header, name: str, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Values for a range of the leading dimension, as read from their place in the file; fill values are NaN."""
    v = h.variables[name]
    shape = tuple(h.dims[d] for d in v.dims)
    if not shape:
        f.seek(v.begin)
        return np.frombuffer(f.read(np.dtype(v.kind).itemsize), v.kind)[0]
    stop = shape[0] if stop is None else min(stop, shape[0])
    slab = math.prod(shape[1:]) * np.dtype(v.kind).itemsize
    if v.record:
        parts = []
        for r in range(start, stop):
            f.seek(v.begin + r * h.record_size)
            parts.append(f.read(slab))
        raw = b"".join(parts)
    else:
        f.seek(v.begin + start * slab)
        raw = f.read((stop - start) * slab)
    out = np.frombuffer(raw, v.kind).reshape((stop - start, *shape[1:]))
    if v.kind == "S1":
        return out
    out = out.astype(out.dtype.newbyteorder("="))
    fill = v.attrs.get("_FillValue", v.attrs.get("missing_value"))
    if fill is not None:
        out = np.where(out == np.asarray(fill, out.dtype), np.nan, out.astype(np.float64))
    if "scale_factor" in v.attrs or "add_offset" in v.attrs:
        out = out.astype(np.float64) * v.attrs.get("scale_factor", 1.0) + v.attrs.get("add_offset", 0.0)
    return out


def write(f: BinaryIO, dims: dict[str, int], variables: dict[str, tuple[tuple[str, ...], np.ndarray, dict]], attrs: dict | None = None) -> None:
    """A CDF-2 file without an unlimited dimension."""
    code = {"i1": 1, "S1": 2, "i2": 3, "i4": 4, "f4": 5, "f8": 6}
    text = lambda s: struct.pack(">i", len(s.encode())) + s.encode().ljust(padded(len(s.encode())), b"\0")

    def attributes(found: dict | None) -> bytes:
        if not found:
            return bytes(8)
        out = [struct.pack(">ii", ATTRIBUTE, len(found))]
        for k, v in found.items():
            if isinstance(v, str):
                out.append(text(k) + struct.pack(">i", 2) + text(v))
            else:
                a = np.atleast_1d(np.asarray(v, ">f8" if np.asarray(v).dtype.kind == "f" else ">i4"))
                out.append(text(k) + struct.pack(">ii", 6 if a.dtype.kind == "f" else 4, len(a)) + a.tobytes().ljust(padded(a.nbytes), b"\0"))
        return b"".join(out)

    names = list(dims)
    head = b"CDF\x02" + struct.pack(">iii", 0, DIMENSION, len(dims)) + b"".join(text(k) + struct.pack(">i", n) for k, n in dims.items()) + attributes(attrs)
    head += struct.pack(">ii", VARIABLE, len(variables)) if variables else bytes(8)
    parts, bodies = [], []
    for k, (of, values, own) in variables.items():
        a = np.asarray(values)
        kind = {"f": f"f{max(4, a.dtype.itemsize)}", "i": "i4", "b": "i1", "S": "S1"}[a.dtype.kind]
        raw = np.ascontiguousarray(a, ">" + kind if kind[1] in "248" else kind).tobytes()
        raw = raw.ljust(padded(len(raw)), b"\0")
        parts.append((text(k) + struct.pack(">i", len(of)) + b"".join(struct.pack(">i", names.index(d)) for d in of) + attributes(own) + struct.pack(">ii", code[kind], len(raw)), len(raw)))
        bodies.append(raw)
    at = len(head) + sum(len(p) + 8 for p, _ in parts)
    for p, n in parts:
        head += p + struct.pack(">q", at)
        at += n
    f.write(head + b"".join(bodies))


@dataclass
class Range(InputPartition):
    start: int
    stop: int


class NetcdfSource(DataSource):
    """spark.read.format("isobar-netcdf").option("path", ...).option("variable", "a,b"). The variables share their dimensions."""

    @classmethod
    def name(cls) -> str:
        return "isobar-netcdf"

    def plan(self) -> tuple[Header, list[str], tuple[str, ...]]:
        with open(self.options["path"].removeprefix("file://"), "rb") as f:
            h = read_header(f)
        asked = self.options.get("variable")
        names = asked.split(",") if asked else data_variables(h)
        if not names or any(n not in h.variables for n in names):
            raise ValueError(f"no variables {names}; there are {sorted(h.variables)}")
        return h, names, h.variables[names[0]].dims

    def schema(self) -> str:
        h, names, dims = self.plan()
        cols = [f"`{d}` {'double' if d in h.variables else 'int'}" for d in dims]
        for d in dims:
            if (b := bounds_of(h, d)) is not None:
                cols += [f"`lb_{d}` double", f"`ub_{d}` double"]
        return ", ".join([*cols, *(f"`{n}` double" for n in names)])

    def reader(self, schema: Any) -> DataSourceReader:
        return NetcdfReader(self)


def bounds_of(h: Header, dim: str) -> str | None:
    """The variable of a coordinate's bounds: two values for each place."""
    v = h.variables.get(dim)
    name = v.attrs.get("bounds") if v else None
    return name if name in h.variables and len(h.variables[name].dims) == 2 else None


def data_variables(h: Header) -> list[str]:
    """The variables of most dimensions that are neither coordinates nor bounds, and share their dimensions."""
    side = {*h.dims, *(bounds_of(h, d) for d in h.dims)}
    found = [v for v in h.variables.values() if v.name not in side and v.kind != "S1" and v.dims]
    most = max(found, key=lambda v: len(v.dims), default=None)
    return [v.name for v in found if v.dims == most.dims] if most else []


class NetcdfReader(DataSourceReader):
    def __init__(self, source: NetcdfSource):
        self.path = source.options["path"].removeprefix("file://")
        self.header, self.names, self.dims = source.plan()
        self.rows = int(source.options.get("rows", 1_000_000))

    def partitions(self) -> list[InputPartition]:
        n = self.header.dims[self.dims[0]]
        step = max(1, self.rows // max(1, math.prod(self.header.dims[d] for d in self.dims[1:])))
        return [Range(k, min(n, k + step)) for k in range(0, n, step)] or [Range(0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        h, dims = self.header, self.dims
        with open(self.path, "rb") as f:
            ranges = [(part.start, part.stop)] + [(0, h.dims[d]) for d in dims[1:]]
            shape = tuple(b - a for a, b in ranges)
            cols, names = [], []
            place = np.indices(shape, np.int32).reshape(len(dims), -1)
            for k, (d, (a, b)) in enumerate(zip(dims, ranges, strict=True)):
                names.append(d)
                cols.append(read_variable(f, h, d, a, b).astype(np.float64)[place[k]] if d in h.variables else (place[k] + a).astype(np.int32))
            for k, (d, (a, b)) in enumerate(zip(dims, ranges, strict=True)):
                if (bounds := bounds_of(h, d)) is not None:
                    both = read_variable(f, h, bounds, a, b).astype(np.float64)
                    for side, pre in enumerate(("lb_", "ub_")):
                        names.append(pre + d)
                        cols.append(both[place[k], side])
            for v in self.names:
                names.append(v)
                cols.append(read_variable(f, h, v, part.start, part.stop).astype(np.float64).ravel())
        made = [pa.array(c, from_pandas=True) for c in cols]
        yield pa.RecordBatch.from_arrays(made, names=names)
