"""Series: one named column, with an order column where its rows have one."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import group_of
from .coordinates import Cells
from .ranges import running

SAFE = (1 << 53) - 1


@dataclass(frozen=True)
class Series:
    df: DataFrame
    name: str
    order: str | None = None

    def _made(self, column, name: str | None = None) -> Series:
        keep = [self.order] if self.order and self.order != self.name else []
        return Series(self.df.select(column.alias(name or self.name), *keep), name or self.name, self.order)

    def get(self, index: int):
        """Value of the row of this rank in the series' order."""
        if self.order is None:
            raise ValueError("the series has no order")
        rows = self.df.orderBy(self.order).offset(index).limit(1).collect()
        return rows[0][self.name] if rows else None

    def to_list(self) -> list:
        df = self.df.orderBy(self.order) if self.order else self.df
        return [r[0] for r in df.select(self.name).collect()]

    def to_vector(self, most: int = 10_000_000) -> pa.ChunkedArray:
        """The column as an Arrow array on the driver, in the series' order, nulls and NaN as they are; more than ``most`` rows raise."""
        df = self.df.orderBy(self.order) if self.order else self.df
        table = df.select(self.name).limit(most + 1).toArrow()
        if table.num_rows > most:
            raise ValueError(f"more than {most} rows")
        return table.column(0)

    def to_tensor(self) -> Cells:
        """The column as a tensor of one axis, by the rank of its rows; a null or what isn't a number raises."""
        if self.order is None:
            raise ValueError("the series has no order")
        if group_of(self.df.schema[self.name].dataType) not in ("int64", "number"):
            raise TypeError(f"{self.name!r} isn't a number")
        rows = running(self.df, self.order, "__rank")
        value = F.when(F.col(self.name).isNull(), F.raise_error(F.lit("null in a tensor"))).otherwise(F.col(self.name)).cast("double")
        return Cells(rows.select(F.col("__rank").alias("i0"), value.alias("v")), (self.df.count(),))

    def to_dates(self) -> Series:
        """Times cut to milliseconds."""
        if group_of(self.df.schema[self.name].dataType) != "time":
            raise TypeError(f"{self.name!r} holds no times")
        return self._made(F.timestamp_millis(F.unix_millis(F.col(self.name).cast("timestamp"))))

    def is_null(self) -> Series:
        return self._made(F.col(self.name).isNull())

    def fill_null(self, value) -> Series:
        return self._made(F.coalesce(self.name, F.lit(value).cast(self.df.schema[self.name].dataType)))

    def unique(self) -> DataFrame:
        """Values once each (null is one); with an order, ``first`` holds where a value is first seen."""
        if self.order is None:
            return self.df.select(self.name).distinct()
        return self.df.groupBy(self.name).agg(F.min(self.order).alias("first"))

    def value_counts(self) -> DataFrame:
        """``(value, count)``, most frequent first, ties by first appearance (by value where there is no order)."""
        aggs = [F.count("*").alias("count")] + ([F.min(self.order).alias("first")] if self.order else [])
        counted = self.df.groupBy(F.col(self.name).alias("value")).agg(*aggs)
        return counted.orderBy(F.desc("count"), F.asc_nulls_last("first" if self.order else "value")).drop("first")

    def cast(self, dtype: str) -> Series:
        """Between numbers and booleans.  To whole numbers it truncates; from int64 beyond 2**53 to floats it raises; to bool it is the truth of the value."""
        kinds = {"bool": "boolean", "int8": "byte", "int16": "short", "int32": "int", "int64": "long", "float32": "float", "float64": "double", "utf8": "string"}
        source = self.df.schema[self.name].dataType
        c = F.col(self.name)
        if isinstance(source, T.StringType):
            if dtype not in ("utf8", "dictionary"):
                raise TypeError(f"can't cast text to {dtype}")
            return self
        if group_of(source) not in ("int64", "number", "bool") or dtype not in kinds or dtype == "utf8":
            raise TypeError(f"can't cast {source.simpleString()} to {dtype}")
        if dtype == "bool":
            real = c.cast("double")
            return self._made(F.when(c.isNull(), None).otherwise((real != 0) & ~F.isnan(real)))
        if isinstance(source, T.LongType) and dtype != "int64":
            c = F.when(F.abs(c) > SAFE, F.raise_error(F.lit("int64 beyond 2**53"))).otherwise(c)
        return self._made(c.cast(kinds[dtype]))
