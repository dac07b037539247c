"""Binary files as tables: Arrow IPC, .npy arrays and safetensors, read where Spark finds them.

Files come through Spark's ``binaryFile`` reader, so paths may be in any store; a task reads whole
files, one row (or one row a tensor) each.
"""

from __future__ import annotations

import io
import json
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTHS = {"BOOL": 1, "U8": 1, "I8": 1, "U16": 2, "I16": 2, "F16": 2, "BF16": 2, "U32": 4, "I32": 4, "F32": 4, "U64": 8, "I64": 8, "F64": 8}
KINDS = {"BOOL": "?", "U8": "u1", "I8": "i1", "U16": "<u2", "I16": "<i2", "F16": "<f2", "U32": "<u4", "I32": "<i4", "F32": "<f4", "U64": "<u8", "I64": "<i8", "F64": "<f8"}
MOST_HEADER = 100 << 20


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _ipc(raw):
    try:
        return pa.ipc.open_file(raw)
    except pa.ArrowInvalid:
        return pa.ipc.open_stream(raw)


def read_ipc(spark: SparkSession, path: str) -> DataFrame:
    """Arrow files or streams of one schema."""
    first = _files(spark, path).limit(1).collect()
    if not first:
        raise FileNotFoundError(path)

    from pyspark.sql.pandas.types import from_arrow_schema

    schema = from_arrow_schema(_ipc(bytes(first[0]["content"])).schema, prefer_timestamp_ntz=True)
    return from_ipc_rows(_files(spark, path), schema)


def ipc_rows(df: DataFrame) -> DataFrame:
    """``(rows, content)``: an Arrow stream for each batch of a task, made where the rows are; NaN stays NaN and null null."""

    def run(batches):
        for batch in batches:
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([sink.getvalue()], pa.binary())], ["rows", "content"])

    return df.mapInArrow(run, "rows long, content binary")


def from_ipc_rows(files: DataFrame, schema) -> DataFrame:
    """The rows of a column ``content`` of Arrow files or streams of this schema."""

    def run(batches):
        for batch in batches:
            for raw in batch.column("content"):
                yield from _ipc(raw.as_buffer()).read_all().to_batches()

    return files.mapInArrow(run, schema)


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """``(path, dtype, shape, values)`` of little-endian arrays in C order."""
    return npy_rows(_files(spark, path))


def npy_rows(files: DataFrame) -> DataFrame:
    """The same of a table ``(path, content)``."""

    def run(batches):
        for pdf in batches:
            out = []
            for p, raw in zip(pdf["path"], pdf["content"]):
                a = np.load(io.BytesIO(raw), allow_pickle=False)
                out.append((p, str(a.dtype), list(a.shape), np.ascontiguousarray(a).ravel().astype(float)))
            yield pd.DataFrame(out, columns=["path", "dtype", "shape", "values"])

    return files.mapInPandas(run, "path string, dtype string, shape array<long>, values array<double>")


def npy_column(values, shape, dtype: str = "<f8"):
    """Bytes of an .npy file from a column of values and one of shapes."""

    @F.pandas_udf("binary")
    def make(v: pd.Series, s: pd.Series) -> pd.Series:
        def one(x, n):
            sink = io.BytesIO()
            np.save(sink, np.asarray(x, dtype).reshape([int(i) for i in n]))
            return sink.getvalue()

        return pd.Series([one(x, n) for x, n in zip(v, s)])

    return make(values, shape)


def safetensors_header(raw: bytes) -> tuple[dict, int]:
    """Checked header and where the data begins: offsets tile the data, shapes fit their bytes, names are single."""
    if len(raw) < 8:
        raise ValueError("too short")
    (n,) = struct.unpack_from("<Q", raw)
    if n > MOST_HEADER or 8 + n > len(raw):
        raise ValueError("header size out of range")

    return tensors_of(raw[8 : 8 + n], len(raw) - 8 - n), 8 + n


def tensors_of(text: bytes, size: int) -> dict:
    """Tensors of a checked header of which ``size`` bytes of data follow."""

    def single(pairs):
        names = [k for k, _ in pairs]
        if len(set(names)) < len(names):
            raise ValueError("a name occurs twice")
        return dict(pairs)

    head = json.loads(text, object_pairs_hook=single)
    tensors = {k: v for k, v in head.items() if k != "__metadata__"}
    at = 0
    for name, t in sorted(tensors.items(), key=lambda x: tuple(x[1]["data_offsets"])):
        a, b = t["data_offsets"]
        if t["dtype"] not in WIDTHS:
            raise ValueError(f"{name}: no type {t['dtype']}")
        if a != at or b - a != WIDTHS[t["dtype"]] * int(np.prod(t["shape"], dtype=np.int64)):
            raise ValueError(f"{name}: offsets don't fit")
        at = b
    if at != size:
        raise ValueError("data size doesn't fit the offsets")
    return tensors


def widened(dtype: str, raw: bytes) -> np.ndarray:
    """Values as doubles; half types exactly."""
    if dtype == "BF16":
        return (np.frombuffer(raw, "<u2").astype(np.uint32) << 16).view(np.float32).astype(float)
    return np.frombuffer(raw, KINDS[dtype]).astype(float)


def read_safetensors(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """``(path, name, dtype, shape, values)``, a row a tensor."""
    return safetensors_rows(_files(spark, path), names)


def safetensors_rows(files: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The same of a table ``(path, content)``; of each file only the named tensors are decoded."""

    def run(batches):
        for pdf in batches:
            for p, raw in zip(pdf["path"], pdf["content"]):
                tensors, base = safetensors_header(raw)
                rows = [
                    (p, k, t["dtype"], t["shape"], widened(t["dtype"], raw[base + t["data_offsets"][0] : base + t["data_offsets"][1]]))
                    for k, t in tensors.items()
                    if names is None or k in names
                ]
                yield pd.DataFrame(rows, columns=["path", "name", "dtype", "shape", "values"])

    return files.mapInPandas(run, "path string, name string, dtype string, shape array<long>, values array<double>")


def safetensors_bytes(tensors: dict[str, np.ndarray], metadata: dict[str, str] | None = None) -> bytes:
    """A checkpoint of (few, driver-side) arrays, such as fitted weights."""
    kinds = {np.dtype(v): k for k, v in KINDS.items()}
    head, body, at = {}, [], 0
    for name, a in tensors.items():
        raw = np.ascontiguousarray(a).tobytes()
        head[name] = {"dtype": kinds[a.dtype], "shape": list(a.shape), "data_offsets": [at, at + len(raw)]}
        body.append(raw)
        at += len(raw)
    if metadata:
        head["__metadata__"] = metadata
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    return struct.pack("<Q", len(text)) + text + b"".join(body)
