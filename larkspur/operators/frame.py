"""Frames: immutable tables with expressions, over a ``DataFrame``.

Row order is only kept where it is asked for: a frame may name a column that holds its order
(``order``), which then breaks ties in ``sort_by`` and fixes what ``limit`` and ``slice`` take.
"""

from __future__ import annotations

import io
import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import Expr, as_expr
from ..types import group_of


@dataclass(frozen=True)
class Key:
    column: str
    descending: bool = False


def desc(column: str) -> Key:
    return Key(column, True)


def csv_cell(c: Column, kind: T.DataType) -> Column:
    """Text of a value in CSV: null is empty, times are ISO, lists and structs JSON; quoted only where it must be."""
    if isinstance(kind, T.TimestampNTZType):
        text = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        text = F.regexp_replace(text, r"(\.\d{3})000Z$", "$1Z")
    elif isinstance(kind, T.TimestampType):
        text = F.regexp_replace(F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), r"(\.\d{3})000Z$", "$1Z")
    elif isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        text = F.to_json(c)
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        text = F.regexp_replace(c.cast("string"), r"\.0$", "")
    else:
        text = c.cast("string")
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(c.isNull(), "").when(text.rlike('[",\n\r]'), quoted).otherwise(text)


@dataclass(frozen=True)
class Frame:
    df: DataFrame
    order: str | None = None
    #: Whether the rows have been sorted since: ``limit`` and ``slice`` then take them as they come.
    is_sorted: bool = False

    # --- shape ---

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    @property
    def schema(self) -> T.StructType:
        return self.df.schema

    def _with(self, df: DataFrame, order: str | None = "same", is_sorted: bool | None = None) -> Frame:
        order = self.order if order == "same" else order
        return Frame(df, order if order in df.columns else None, self.is_sorted if is_sorted is None else is_sorted)

    def _known(self, names: Sequence[str]) -> None:
        for n in names:
            if n not in self.columns:
                raise KeyError(f"no column {n!r}; there are {', '.join(self.columns)}")

    # --- columns and rows ---

    def select(self, *names: str) -> Frame:
        self._known(names)
        if len(set(names)) < len(names):
            raise ValueError("a column is selected twice")
        return self._with(self.df.select(*[self.df[n] for n in names]))

    def drop(self, *names: str) -> Frame:
        return self._with(self.df.drop(*names))

    def rename(self, mapping: dict[str, str]) -> Frame:
        mapping = {a: b for a, b in mapping.items() if a in self.columns and b}
        new = [mapping.get(c, c) for c in self.columns]
        if len(set(new)) < len(new):
            raise ValueError("two columns would have the same name")
        return self._with(self.df.withColumnsRenamed(mapping), mapping.get(self.order, self.order))

    def with_columns(self, columns: dict[str, Expr]) -> Frame:
        """All expressions see the input frame; existing names are overwritten in place."""
        return self._with(self.df.withColumns({n: self._row_wise(e) for n, e in columns.items()}))

    def _row_wise(self, e) -> Column:
        e = as_expr(e)
        if e.is_aggregate:
            raise TypeError("an aggregate needs group_by or over_all")
        return e.build(self.df).column

    def filter(self, predicate: Expr) -> Frame:
        """Rows for which the predicate is true (not null)."""
        return self._with(self.df.where(self._row_wise(predicate)))

    def drop_null(self, *names: str) -> Frame:
        """Rows without a null in the columns (all by default); NaN stays."""
        self._known(names)
        return self._with(self.df.where(reduce(lambda a, b: a & b, [self.df[n].isNotNull() for n in names or self.columns])))

    def fill_null(self, value) -> Frame:
        """One value for all columns of its type, or one for each named column."""
        if not isinstance(value, dict):
            group = "bool" if isinstance(value, bool) else "text" if isinstance(value, str) else "number"
            value = {f.name: value for f in self.schema if group_of(f.dataType) in ((group, "int64") if group == "number" else (group,))}
        self._known(list(value))
        return self._with(self.df.withColumns({n: F.coalesce(self.df[n], F.lit(v).cast(self.schema[n].dataType)) for n, v in value.items()}))

    # --- order ---

    def sort_by(self, *keys: str | Key) -> Frame:
        """Nulls last in both directions; ties by the frame's order, where it has one."""
        keys = [k if isinstance(k, Key) else Key(k) for k in keys]
        self._known([k.column for k in keys])
        by = [F.desc_nulls_last(k.column) if k.descending else F.asc_nulls_last(k.column) for k in keys]
        return self._with(self.df.orderBy(*by, *([F.asc(self.order)] if self.order else [])), is_sorted=True)

    def limit(self, n: int) -> Frame:
        return self.slice(0, n)

    def slice(self, start: int, end: int | None = None) -> Frame:
        if start < 0 or end is not None and end < 0:
            raise ValueError("rows are counted from 0")
        df = self.df if self.is_sorted or not self.order else self.df.orderBy(F.asc(self.order))
        df = df.offset(start) if start else df
        return self._with(df if end is None else df.limit(max(0, end - start)))

    # --- several frames ---

    def join(self, other: Frame, on: str | Sequence[str], how: str = "inner", suffix: str = "_right") -> Frame:
        """Equi-join on columns of one name.  Nulls never match; the key comes once, in the left type; other right columns of a left name get the suffix."""
        if how not in ("inner", "left", "right", "outer"):
            raise ValueError(f"no join {how!r}")
        keys = [on] if isinstance(on, str) else list(on)
        self._known(keys)
        other._known(keys)
        right = other.df.withColumnsRenamed({c: c + suffix for c in other.columns if c in self.columns and c not in keys})
        joined = self.df.join(right, keys, "full" if how == "outer" else how)
        rest = [c for c in self.columns if c not in keys] + [c for c in right.columns if c not in keys]
        back = {k: joined[k].cast(self.schema[k].dataType) for k in keys}
        made = joined.select(*[back[k].alias(k) for k in keys], *[joined[c] for c in rest])
        return Frame(made.select(*[c for c in self.columns], *[c for c in right.columns if c not in keys]))

    def concat(self, *others: Frame) -> Frame:
        return concat([self, *others])

    def group_by(self, *keys: str) -> GroupBy:
        self._known(keys)
        return GroupBy(self, keys)

    # --- results ---

    def length(self) -> int:
        return self.df.count()

    def null_count(self) -> dict[str, int]:
        row = self.df.agg(*[F.count_if(self.df[c].isNull()).alias(c) for c in self.columns]).first()
        return row.asDict()

    def get_series(self, name: str):
        from .series import Series

        self._known([name])
        return Series(self.df.select(name, *([self.order] if self.order and self.order != name else [])), name, self.order)

    def to_arrow(self) -> pa.Table:
        return self.df.toArrow()

    def to_rows(self) -> list[dict]:
        """Rows as dicts; times are whole epochs in microseconds."""
        times = [f.name for f in self.schema if group_of(f.dataType) == "time"]
        df = self.df.withColumns({n: F.unix_micros(F.col(n).cast("timestamp")) for n in times})
        return [r.asDict(True) for r in df.collect()]

    def json_rows(self) -> DataFrame:
        """A column ``json`` of rows as JSON, int64 as text so that no digit is lost."""
        cells = [F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, T.LongType) else F.col(f.name) for f in self.schema]
        return self.df.select(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}).alias("json"))

    def csv_lines(self) -> DataFrame:
        """A column ``line`` of rows as CSV, without header; written where the rows are."""
        return self.df.select(F.concat_ws(",", *[csv_cell(self.df[f.name], f.dataType) for f in self.schema]).alias("line"))

    def _header(self) -> str:
        quote = lambda c: '"' + c.replace('"', '""') + '"' if any(x in c for x in '",\n\r') else c
        return ",".join(map(quote, self.columns))

    def header_lines(self) -> DataFrame:
        """``csv_lines`` with the header as the first line of each partition."""
        head = self._header()

        def run(batches):
            first, shape = True, pa.schema([("line", pa.string())])
            for batch in batches:
                if first:
                    first, shape = False, batch.schema
                    yield pa.RecordBatch.from_arrays([pa.array([head], shape.field(0).type)], schema=shape)
                yield batch
            if first:
                yield pa.RecordBatch.from_arrays([pa.array([head], pa.string())], schema=shape)

        return self.csv_lines().mapInArrow(run, "line string")

    def to_csv(self) -> str:
        return "\n".join([self._header(), *[r.line for r in self.csv_lines().collect()]]) + "\n"

    def to_ipc(self) -> bytes:
        sink = io.BytesIO()
        table = self.to_arrow()
        with pa.ipc.new_file(sink, table.schema) as out:
            out.write_table(table)
        return sink.getvalue()

    def to_tensor(self, columns: Sequence[str] | None = None) -> DataFrame:
        """A column ``values`` of row vectors of doubles; a null or a column that isn't a number raises."""
        names = list(columns or self.columns)
        for n in names:
            if group_of(self.schema[n].dataType) not in ("int64", "number"):
                raise TypeError(f"column {n!r} isn't a number")
        cells = [F.when(self.df[n].isNull(), F.raise_error(F.lit(f"null in column {n!r}"))).otherwise(self.df[n]).cast("double") for n in names]
        return self.df.select(F.array(*cells).alias("values"), *([self.order] if self.order and self.order not in names else []))


@dataclass(frozen=True)
class GroupBy:
    frame: Frame
    keys: tuple

    def aggregate(self, columns: dict[str, Expr]) -> Frame:
        """Keys, then aggregates in the order given.  Null keys form a group; without keys there is one row."""
        made = []
        for name, e in columns.items():
            if not e.is_aggregate:
                raise TypeError(f"{name!r} isn't an aggregate")
            made.append(e.build(self.frame.df).column.alias(name))
        return Frame(self.frame.df.groupBy(*self.keys).agg(*made))


def from_arrow(spark: SparkSession, table: pa.Table, order: str | None = None) -> Frame:
    """A frame of an Arrow table; with ``order``, a column of that name numbers its rows."""
    if order is not None:
        table = table.append_column(order, pa.array(range(table.num_rows), pa.int64()))
    return Frame(spark.createDataFrame(table), order)


def concat(frames: Sequence[Frame]) -> Frame:
    """All rows of all frames; names must match in order, the first frame's types hold."""
    if not frames:
        raise ValueError("no frames")
    first = frames[0]
    for f in frames[1:]:
        if f.columns != first.columns:
            raise ValueError(f"columns differ: {first.columns} and {f.columns}")
    cast = lambda f: f.df.select(*[f.df[x.name].cast(x.dataType).alias(x.name) for x in first.schema])
    return Frame(reduce(DataFrame.union, [first.df, *map(cast, frames[1:])]), first.order)


def stringify_rows(rows: list[dict]) -> str:
    """JSON of collected rows with whole numbers beyond 2**53 as text."""
    safe = lambda v: str(v) if isinstance(v, int) and not isinstance(v, bool) and abs(v) > 2**53 - 1 else v
    return json.dumps([{k: safe(v) for k, v in r.items()} for r in rows])
