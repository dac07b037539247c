"""Parquet: filters written as nested dicts, globs, codecs, and a strict type check.

A filter becomes a ``Column``; Spark pushes it and the selected columns into the scan.
"""

from __future__ import annotations

import io
from collections.abc import Sequence
from functools import reduce

import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..types import check_strict

CODECS = ("snappy", "zstd", "uncompressed")
COMPARE = {
    "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v, "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v,
    "$eq": lambda c, v: c.isNull() if v is None else c == v, "$ne": lambda c, v: c.isNotNull() if v is None else c != v,
    "$in": lambda c, v: c.isin(*v) if v else F.lit(False), "$nin": lambda c, v: ~c.isin(*v) if v else F.lit(True),
}


def filter_column(spec: dict) -> Column:
    """``{"a": {"$gt": 1}, "$or": [...]}`` as a condition; several entries must all hold."""
    parts = []
    for key, value in spec.items():
        if key == "$and":
            parts.append(reduce(lambda a, b: a & b, map(filter_column, value)))
        elif key == "$or":
            parts.append(reduce(lambda a, b: a | b, map(filter_column, value)))
        elif key == "$not":
            parts.append(~filter_column(value))
        elif isinstance(value, dict):
            for op, v in value.items():
                if op == "$not":
                    parts.append(~filter_column({key: v}))
                elif op in COMPARE:
                    parts.append(COMPARE[op](F.col(key), v))
                else:
                    raise ValueError(f"no filter {op!r}")
        else:
            parts.append(COMPARE["$eq"](F.col(key), value))
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def read_parquet(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None, filter: dict | None = None, strict: bool = False) -> DataFrame:
    """A file, folder or glob.  Columns that don't exist raise; in strict mode so do columns that are read and have an unsupported type."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    if missing := [c for c in columns or () if c not in df.columns]:
        raise KeyError(f"no columns {missing}; there are {', '.join(df.columns)}")
    if filter:
        df = df.where(filter_column(filter))
    if columns is not None:
        df = df.select(*columns)
    return check_strict(df) if strict else df


def with_file_order(df: DataFrame, name: str = "row_order") -> DataFrame:
    """A column that sorts rows by file path and place in the file."""
    return df.withColumn(name, F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.col("_metadata.row_index")))


def write_parquet(df: DataFrame, path: str, compression: str = "snappy", row_group_bytes: int | None = None, mode: str = "error") -> None:
    if compression not in CODECS:
        raise ValueError(f"no codec {compression!r}; there are {', '.join(CODECS)}")
    out = df.write.mode(mode).option("compression", compression)
    if row_group_bytes:
        out = out.option("parquet.block.size", row_group_bytes)
    out.parquet(path)


def parquet_bytes(df: DataFrame, compression: str = "snappy") -> bytes:
    """A (small) result as the bytes of one file."""
    if compression not in CODECS:
        raise ValueError(f"no codec {compression!r}; there are {', '.join(CODECS)}")
    sink = io.BytesIO()
    pq.write_table(df.toArrow(), sink, compression="none" if compression == "uncompressed" else compression)
    return sink.getvalue()
