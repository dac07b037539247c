"""Column types of frames: a closed set, arithmetic rules, and a strict check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


class UnsupportedTypeError(TypeError):
    """A column has a type that strict frames reject; the message names the column."""


SCALARS = {
    "bool": T.BooleanType(),
    "int8": T.ByteType(),
    "int16": T.ShortType(),
    "int32": T.IntegerType(),
    "uint8": T.ShortType(),
    "uint16": T.IntegerType(),
    "uint32": T.LongType(),
    "int64": T.LongType(),
    "float32": T.FloatType(),
    "float64": T.DoubleType(),
    "utf8": T.StringType(),
    "dictionary": T.StringType(),
    "timestamp_ms": T.TimestampNTZType(),
    "timestamp_us": T.TimestampNTZType(),
}
RANGES = {"uint8": (0, 255), "uint16": (0, 65535), "uint32": (0, 4294967295), "int8": (-128, 127), "int16": (-32768, 32767)}


def dtype_of(field: T.StructField) -> str:
    """Frame type of a column: its tag in the field's metadata if there is one, else by Spark type."""
    if tag := (field.metadata or {}).get("dtype"):
        return tag
    kind = field.dataType
    for name in ("bool", "int8", "int16", "int32", "int64", "float32", "float64", "utf8"):
        if kind == SCALARS[name]:
            return name
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp_us"
    if isinstance(kind, T.ArrayType):
        return "list"
    if isinstance(kind, T.StructType):
        return "struct"
    return kind.simpleString()


def tagged(name: str, dtype: str, **metadata) -> T.StructField:
    """A field of a frame type that Spark lacks (unsigned, dictionary, time unit), kept as a tag in its metadata."""
    return T.StructField(name, SCALARS[dtype], True, {"dtype": dtype, **metadata})


def check_strict(df: DataFrame, columns=None) -> DataFrame:
    """Raise ``UnsupportedTypeError`` for a column that only extended frames take: maps, decimals, dates, binary, deeper nesting."""

    def scalar(kind) -> bool:
        return isinstance(kind, (T.TimestampType, T.TimestampNTZType)) or kind in SCALARS.values()

    for f in df.schema:
        if columns is not None and f.name not in columns:
            continue
        kind = f.dataType
        fine = scalar(kind) or isinstance(kind, T.ArrayType) and scalar(kind.elementType) or isinstance(kind, T.StructType) and all(scalar(c.dataType) for c in kind)
        if not fine:
            raise UnsupportedTypeError(f"column {f.name!r} has type {kind.simpleString()}")
    return df


def group_of(kind: T.DataType) -> str:
    """Group that arithmetic and comparison rules go by."""
    if isinstance(kind, T.LongType):
        return "int64"
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.FloatType, T.DoubleType, T.DecimalType)):
        return "number"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "time"
    if isinstance(kind, T.BooleanType):
        return "bool"
    return "text" if isinstance(kind, T.StringType) else "other"
