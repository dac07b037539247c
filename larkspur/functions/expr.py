"""Expressions of frames: immutable, typed against the frame they are used on, compiled to ``Column``.

Literal numbers are float64 and literal ints beyond a frame's int64 columns are made with ``int64``.
Arithmetic stays int64 only if both sides are; everything else is float64.  Comparisons with NaN are
false (``ne``: true), with null null.  int64 overflow and int64 division by zero raise, as Spark does.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import group_of
from . import scalar


@dataclass(frozen=True)
class Typed:
    column: Column
    group: str  # int64, number, text, bool, time, other

    def number(self) -> Column:
        if self.group == "time":
            return F.unix_millis(self.column.cast("timestamp")).cast("double")
        if self.group not in ("int64", "number"):
            raise TypeError(f"a number is needed, not {self.group}")
        return self.column.cast("double")


@dataclass(frozen=True, eq=False)
class Expr:
    """``build`` makes the typed column for a frame; ``required`` are the columns it reads."""

    build: Callable[[DataFrame], Typed]
    required: frozenset = field(default_factory=frozenset)
    is_aggregate: bool = False

    def _binary(self, other, make) -> Expr:
        other = as_expr(other)
        return Expr(lambda df: make(self.build(df), other.build(df)), self.required | other.required, self.is_aggregate or other.is_aggregate)

    def eq(self, other):
        return self._binary(other, lambda a, b: _compare(a, b, lambda x, y: x == y, False))

    def ne(self, other):
        return self._binary(other, lambda a, b: _compare(a, b, lambda x, y: x != y, True))

    def lt(self, other):
        return self._binary(other, lambda a, b: _compare(a, b, lambda x, y: x < y, False))

    def lte(self, other):
        return self._binary(other, lambda a, b: _compare(a, b, lambda x, y: x <= y, False))

    def gt(self, other):
        return self._binary(other, lambda a, b: _compare(a, b, lambda x, y: x > y, False))

    def gte(self, other):
        return self._binary(other, lambda a, b: _compare(a, b, lambda x, y: x >= y, False))

    def and_(self, other):
        return self._binary(other, lambda a, b: Typed(a.column & b.column, "bool"))

    def or_(self, other):
        return self._binary(other, lambda a, b: Typed(a.column | b.column, "bool"))

    def not_(self):
        return Expr(lambda df: Typed(~self.build(df).column, "bool"), self.required, self.is_aggregate)

    def add(self, other):
        return self._binary(other, lambda a, b: _arithmetic(a, b, lambda x, y: x + y))

    def sub(self, other):
        return self._binary(other, lambda a, b: _arithmetic(a, b, lambda x, y: x - y))

    def mul(self, other):
        return self._binary(other, lambda a, b: _arithmetic(a, b, lambda x, y: x * y))

    def div(self, other):
        def make(a: Typed, b: Typed) -> Typed:
            if a.group == b.group == "int64":
                return Typed(F.call_function("div", a.column, b.column), "int64")
            return Typed(scalar.divide(a.number(), b.number()), "number")

        return self._binary(other, make)

    def over_all(self):
        """An aggregate of the whole frame as a value of every row: a scalar subquery, no window over all rows."""
        if not self.is_aggregate:
            raise TypeError("over_all needs an aggregate")

        def build(df: DataFrame) -> Typed:
            made = self.build(df)
            return Typed(df.agg(made.column.alias("value")).scalar(), made.group)

        return Expr(build, self.required)

    __add__, __sub__, __mul__, __truediv__ = add, sub, mul, div
    __lt__, __le__, __gt__, __ge__, __eq__, __ne__ = lt, lte, gt, gte, eq, ne
    __and__, __or__, __invert__ = and_, or_, not_
    __hash__ = object.__hash__


def _arithmetic(a: Typed, b: Typed, f) -> Typed:
    if a.group == b.group == "int64":
        return Typed(f(a.column, b.column), "int64")
    return Typed(f(a.number(), b.number()), "number")


def _compare(a: Typed, b: Typed, f, with_nan: bool) -> Typed:
    numeric = ("int64", "number", "time")
    if a.group == b.group and a.group != "number":
        return Typed(f(a.column, b.column), "bool")
    if a.group in numeric and b.group in numeric:
        x, y = a.number(), b.number()
        odd = F.isnan(x) | F.isnan(y)
        made = f(x, y) | odd if with_nan else f(x, y) & ~odd
        return Typed(F.when(x.isNull() | y.isNull(), None).otherwise(made), "bool")
    raise TypeError(f"can't compare {a.group} with {b.group}")


def as_expr(x) -> Expr:
    return x if isinstance(x, Expr) else lit(x)


def col(name: str) -> Expr:
    def build(df: DataFrame) -> Typed:
        if name not in df.columns:
            raise KeyError(f"no column {name!r}; there are {', '.join(df.columns)}")
        return Typed(df[name], group_of(df.schema[name].dataType))

    return Expr(build, frozenset([name]))


def lit(value) -> Expr:
    if value is None:
        made = Typed(F.lit(None).cast("double"), "number")
    elif isinstance(value, bool):
        made = Typed(F.lit(value), "bool")
    elif isinstance(value, (int, float)):
        made = Typed(F.lit(float(value)), "number")
    elif isinstance(value, str):
        made = Typed(F.lit(value), "text")
    else:
        raise TypeError(f"no literal of type {type(value).__name__}")
    return Expr(lambda df: made)


def int64(value: int) -> Expr:
    return Expr(lambda df: Typed(F.lit(value).cast("long"), "int64"))


class _Functions:
    """``fn``: aggregates, ``month``, and every function of ``scalar.UNARY`` by name."""

    def count(self, x=None) -> Expr:
        if x is None:
            return Expr(lambda df: Typed(F.count(F.lit(1)), "int64"), is_aggregate=True)
        x = as_expr(x)
        return Expr(lambda df: Typed(F.count(x.build(df).column), "int64"), x.required, True)

    def sum(self, x) -> Expr:
        """Sum without nulls; 0 of nothing."""

        def build(df: DataFrame) -> Typed:
            made = x.build(df)
            if made.group == "int64":
                return Typed(F.coalesce(F.sum(made.column), F.lit(0).cast("long")), "int64")
            return Typed(F.coalesce(F.sum(made.number()), F.lit(0.0)), "number")

        return Expr(build, x.required, True)

    def mean(self, x) -> Expr:
        return Expr(lambda df: Typed(F.avg(x.build(df).number()), "number"), x.required, True)

    def stddev(self, x) -> Expr:
        """Sample deviation; 0 of one value."""

        def build(df: DataFrame) -> Typed:
            v = x.build(df).number()
            return Typed(F.when(F.count(v) == 1, F.lit(0.0)).otherwise(F.stddev_samp(v)), "number")

        return Expr(build, x.required, True)

    def month(self, x) -> Expr:
        return Expr(lambda df: Typed(F.month(x.build(df).column), "number"), x.required)

    def __getattr__(self, name: str):
        if name not in scalar.UNARY:
            raise AttributeError(name)
        f = scalar.UNARY[name]

        def call(x) -> Expr:
            x = as_expr(x)
            return Expr(lambda df: Typed(f(x.build(df).number()), "number"), x.required, x.is_aggregate)

        return call


fn = _Functions()
