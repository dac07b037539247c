"""Safetensors files of any size: byte ranges of the wanted tensors only, read by seeking.

The header alone is read to plan.  Wanted tensors that lie close to each other make one range; a tensor
longer than a range is cut into several, so that no task holds more than ``most`` bytes.  Paths are
those that ``pyarrow.fs`` opens (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith

from .binary import KINDS, MOST_HEADER, WIDTHS, safetensors_bytes, tensors_of, widened
from .lazy import PUSHED

SCHEMA = "path string, name string, dtype string, shape array<long>, start long, values array<double>"


def located(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path within it."""
    path = re.sub(r"^file:/(?!/)", "file:///", path)
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path))


def files_of(path: str) -> list[str]:
    """Files at ``path``: itself, or the ``.safetensors`` files of a folder."""
    store, inner = located(path)
    if store.get_file_info(inner).type != fs.FileType.Directory:
        return [path]
    names = sorted(f.base_name for f in store.get_file_info(fs.FileSelector(inner)) if f.base_name.endswith(".safetensors"))
    return [f"{path.rstrip('/')}/{n}" for n in names]


def read_bytes(path: str, start: int, size: int) -> bytes:
    store, inner = located(path)
    with store.open_input_file(inner) as f:
        f.seek(start)
        return f.read(size)


def header(path: str) -> tuple[dict, int]:
    """Checked tensors of a file and where the data begins; two small reads."""
    store, inner = located(path)
    size = store.get_file_info(inner).size
    if size is None or size < 8:
        raise ValueError(f"{path}: too short")
    (n,) = struct.unpack("<Q", read_bytes(path, 0, 8))
    if n > MOST_HEADER or 8 + n > size:
        raise ValueError(f"{path}: header size out of range")
    return tensors_of(read_bytes(path, 8, n), size - 8 - n), 8 + n


@dataclass
class Range(InputPartition):
    """Bytes of one file that are read at once, and the pieces of tensors in them: ``(name, dtype, shape, first value, place, bytes)``."""

    path: str
    start: int
    size: int
    pieces: list[tuple[str, str, list[int], int, int, int]]


def ranges_of(path: str, tensors: dict, base: int, wanted: Callable[[str], bool], gap: int, most: int) -> list[Range]:
    """Ranges of up to ``most`` bytes that hold the wanted tensors; bytes between two of them are read along if they are at most ``gap``."""
    pieces = []
    for name, t in tensors.items():
        if wanted(name):
            width, (a, b) = WIDTHS[t["dtype"]], t["data_offsets"]
            step = max(1, most // width) * width
            pieces += [(name, t["dtype"], t["shape"], (p - a) // width, base + p, min(step, b - p)) for p in range(a, b, step)] or [(name, t["dtype"], t["shape"], 0, base + a, 0)]
    out: list[Range] = []
    for piece in sorted(pieces, key=lambda p: p[4:]):
        at, size = piece[4:]
        if out and at - (out[-1].start + out[-1].size) <= gap and at + size - out[-1].start <= most:
            out[-1].size = at + size - out[-1].start
            out[-1].pieces.append(piece)
        else:
            out.append(Range(path, at, size, [piece]))
    return out


class TensorReader(DataSourceReader):
    """Ranges are partitions."""

    def __init__(self, files: Sequence[str], names: set[str] | None, gap: int, most: int):
        self.files, self.names, self.gap, self.most, self.tests = list(files), names, gap, most, []

    def wanted(self, name: str) -> bool:
        fits = {EqualTo: lambda v: name == v, In: lambda v: name in v, StringStartsWith: name.startswith}
        return (self.names is None or name in self.names) and all(fits[type(f)](f.value) for f in self.tests)

    def partitions(self):
        return [r for path in self.files for r in ranges_of(path, *header(path), self.wanted, self.gap, self.most)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        raw = read_bytes(partition.path, partition.start, partition.size)
        for name, dtype, shape, first, at, size in partition.pieces:
            values = widened(dtype, raw[at - partition.start : at - partition.start + size])
            columns = [[partition.path], [name], [dtype], [shape], [first], [values]]
            kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "name", "dtype", "shape", "start", "values"])


class FilteredTensorReader(TensorReader):
    """Filters on ``name`` (equal, one of, starts with) narrow the ranges."""

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and tuple(f.attribute) == ("name",):
                self.tests.append(f)
            else:
                yield f


def read_many(spark: SparkSession, path: str, names: Sequence[str] | None = None, *, gap: int = 64 << 10, most: int = 32 << 20) -> DataFrame:
    """``(path, name, dtype, shape, start, values)`` of the named tensors (or all) of a file or folder.

    Where the session pushes filters to Python sources (``PUSHED``), one on ``name`` narrows what is read, too.
    A tensor of up to ``most`` bytes is one row, a longer one several, ``start`` being the number of
    their first value.  A name that no file has is an error.
    """
    files = files_of(path)
    if names is not None:
        missing = set(names) - {n for f in files for n in header(f)[0]}
        if missing:
            raise KeyError(f"no tensor {', '.join(sorted(missing))}")
    chosen = None if names is None else set(names)
    reads = FilteredTensorReader if spark.conf.get(PUSHED) == "true" else TensorReader
    kind = f"tensors_{uuid.uuid4().hex}"

    class Tensors(DataSource):
        @classmethod
        def name(cls):
            return kind

        def schema(self):
            return SCHEMA

        def reader(self, schema):
            return reads(files, chosen, gap, most)

    spark.dataSource.register(Tensors)
    return spark.read.format(kind).load()


def write_tensors(path: str, tensors: dict[str, np.ndarray], metadata: dict[str, str] | None = None) -> None:
    """A file of few arrays that the driver holds, such as fitted weights."""
    store, inner = located(path)
    store.create_dir(os.path.dirname(inner), recursive=True)
    with store.open_output_stream(inner) as f:
        f.write(safetensors_bytes(tensors, metadata))


def write_shards(rows: DataFrame, folder: str, columns: dict[str, str]) -> list[str]:
    """Numeric columns (scalars, or vectors of one length) of all rows as tensors in ``folder``; a file a task, named by its partition.

    ``columns`` maps names to types of the format.  Each Arrow batch gives a tensor ``name/number`` a
    column, with a row a row.  Rows hold no nulls.  A task that runs again writes the same file again.
    """
    names = list(columns)

    def write(batches):
        from pyspark import TaskContext

        held: dict[str, np.ndarray] = {}
        for k, batch in enumerate(batches):
            for n in names:
                col = batch.column(n)
                if col.null_count:
                    raise ValueError(f"{n} holds nulls")
                flat = col.flatten() if pa.types.is_list(col.type) else col
                if flat.null_count:
                    raise ValueError(f"{n} holds nulls")
                wide = len(flat) // batch.num_rows if pa.types.is_list(col.type) and batch.num_rows else None
                a = flat.to_numpy(zero_copy_only=False).astype(KINDS[columns[n]])
                held[f"{n}/{k}"] = a if wide is None else a.reshape(batch.num_rows, wide)
        if held:
            path = f"{folder.rstrip('/')}/part-{TaskContext.get().partitionId():05d}.safetensors"
            write_tensors(path, held)
            yield pa.RecordBatch.from_arrays([pa.array([path])], ["path"])

    return sorted(r["path"] for r in rows.select(*names).mapInArrow(write, "path string").collect())


def rows_of(tensors: DataFrame, width: int) -> DataFrame:
    """``(path, number, row, values)`` of ``name/number`` tensors of ``width`` values a row, also where rows are cut by a range."""
    place = F.col("start") + F.col("at")
    each = tensors.select("path", F.substring_index("name", "/", -1).cast("int").alias("number"), "start", F.posexplode("values").alias("at", "v"))
    if width == 1:
        return each.select("path", "number", place.alias("row"), F.col("v").alias("values"))
    grouped = each.groupBy("path", "number", F.floor(place / width).cast("long").alias("row")).agg(F.sort_array(F.collect_list(F.struct((place % width).alias("k"), "v"))).alias("s"))
    return grouped.select("path", "number", "row", F.transform("s", lambda x: x["v"]).alias("values"))
