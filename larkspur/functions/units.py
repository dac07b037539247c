"""Units of columns: kept in field metadata, converted by arithmetic that Catalyst folds into the plan."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base dimensions (length, mass, time, current, temperature, amount, luminosity), prefixes, and units as (dimension, factor, offset).
PREFIXES = {"Y": 1e24, "Z": 1e21, "E": 1e18, "P": 1e15, "T": 1e12, "G": 1e9, "M": 1e6, "k": 1e3, "h": 1e2, "da": 1e1, "d": 1e-1, "c": 1e-2, "m": 1e-3, "u": 1e-6, "µ": 1e-6, "n": 1e-9, "p": 1e-12, "f": 1e-15, "a": 1e-18, "z": 1e-21, "y": 1e-24}
UNITS = {
    "m": ((1, 0, 0, 0, 0, 0, 0), 1.0, 0.0), "g": ((0, 1, 0, 0, 0, 0, 0), 1e-3, 0.0), "s": ((0, 0, 1, 0, 0, 0, 0), 1.0, 0.0), "A": ((0, 0, 0, 1, 0, 0, 0), 1.0, 0.0),
    "K": ((0, 0, 0, 0, 1, 0, 0), 1.0, 0.0), "mol": ((0, 0, 0, 0, 0, 1, 0), 1.0, 0.0), "cd": ((0, 0, 0, 0, 0, 0, 1), 1.0, 0.0), "N": ((1, 1, -2, 0, 0, 0, 0), 1.0, 0.0),
    "J": ((2, 1, -2, 0, 0, 0, 0), 1.0, 0.0), "W": ((2, 1, -3, 0, 0, 0, 0), 1.0, 0.0), "Pa": ((-1, 1, -2, 0, 0, 0, 0), 1.0, 0.0), "Hz": ((0, 0, -1, 0, 0, 0, 0), 1.0, 0.0),
    "V": ((2, 1, -3, -1, 0, 0, 0), 1.0, 0.0), "C": ((0, 0, 1, 1, 0, 0, 0), 1.0, 0.0), "min": ((0, 0, 1, 0, 0, 0, 0), 60.0, 0.0), "h": ((0, 0, 1, 0, 0, 0, 0), 3600.0, 0.0),
    "day": ((0, 0, 1, 0, 0, 0, 0), 86400.0, 0.0), "L": ((3, 0, 0, 0, 0, 0, 0), 1e-3, 0.0), "in": ((1, 0, 0, 0, 0, 0, 0), 0.0254, 0.0), "ft": ((1, 0, 0, 0, 0, 0, 0), 0.3048, 0.0),
    "yd": ((1, 0, 0, 0, 0, 0, 0), 0.9144, 0.0), "mi": ((1, 0, 0, 0, 0, 0, 0), 1609.344, 0.0), "oz": ((0, 1, 0, 0, 0, 0, 0), 0.028349523125, 0.0), "lb": ((0, 1, 0, 0, 0, 0, 0), 0.45359237, 0.0), "degC": ((0, 0, 0, 0, 1, 0, 0), 1.0, 273.15),
    "degF": ((0, 0, 0, 0, 1, 0, 0), 5 / 9, 459.67 * 5 / 9), "eV": ((2, 1, -2, 0, 0, 0, 0), 1.602176634e-19, 0.0),
}

#: Units that take no prefix.
BARE = {"min", "h", "day", "in", "ft", "yd", "mi", "oz", "lb", "degC", "degF"}


@dataclass(frozen=True)
class Unit:
    dimension: tuple
    factor: float
    offset: float = 0.0
    text: str = ""

    def __mul__(self, other: Unit) -> Unit:
        return self._product(other, 1)

    def __truediv__(self, other: Unit) -> Unit:
        return self._product(other, -1)

    def _product(self, other: Unit, sign: int) -> Unit:
        if self.offset or other.offset:
            raise ValueError("a unit with an offset can't be multiplied")
        dimension = tuple(a + sign * b for a, b in zip(self.dimension, other.dimension))
        return Unit(dimension, self.factor * other.factor**sign, text=f"{self.text}{'*' if sign > 0 else '/'}{other.text}")

    def __pow__(self, n: int) -> Unit:
        if self.offset:
            raise ValueError("a unit with an offset has no powers")
        return Unit(tuple(a * n for a in self.dimension), self.factor**n, text=f"{self.text}^{n}")


def symbol(name: str) -> Unit:
    if name in ("", "1"):
        return Unit((0,) * 7, 1.0, text=name)
    if name in UNITS:
        return Unit(*UNITS[name], text=name)
    for prefix in sorted(PREFIXES, key=len, reverse=True):
        rest = name[len(prefix) :]
        if name.startswith(prefix) and rest in UNITS and rest not in BARE:
            d, f, _ = UNITS[rest]
            return Unit(d, f * PREFIXES[prefix], text=name)
    raise ValueError(f"no unit {name!r}")


def unit(text: str) -> Unit:
    """``kg*m/s^2``: factors, left to right."""
    out, sign = None, "*"
    for op, name, power in re.findall(r"([*/]?)\s*([^*/^\s]+)(?:\^(-?\d+))?", text):
        u = symbol(name) ** int(power) if power else symbol(name)
        out = u if out is None else out * u if (op or sign) == "*" else out / u
    return out if out is not None else symbol("")


def convert(c: Column, source: str, target: str) -> Column:
    return converted(c, unit(source), unit(target))


def converted(c: Column, a: Unit, b: Unit) -> Column:
    """A column in unit ``a`` as one in ``b``."""
    if a.dimension != b.dimension:
        raise ValueError(f"{a.text} and {b.text} measure different things")
    return (c * a.factor + (a.offset - b.offset)) / b.factor


def with_unit(df: DataFrame, column: str, text: str) -> DataFrame:
    unit(text)
    return df.withMetadata(column, {**(df.schema[column].metadata or {}), "unit": text})


def unit_of(df: DataFrame, column: str) -> str:
    return (df.schema[column].metadata or {}).get("unit", "")


def to_unit(df: DataFrame, column: str, text: str) -> DataFrame:
    """The column in another unit of the same dimension."""
    return with_unit(df.withColumn(column, convert(F.col(column), unit_of(df, column), text)), column, text)


def add_columns(df: DataFrame, one: str, two: str, name: str, sign: int = 1) -> DataFrame:
    """Sum or difference in the first column's unit."""
    u = unit_of(df, one)
    return with_unit(df.withColumn(name, F.col(one) + sign * convert(F.col(two), unit_of(df, two), u)), name, u)


def multiply_columns(df: DataFrame, one: str, two: str, name: str, sign: int = 1) -> DataFrame:
    """Product or quotient with the unit that follows."""
    u = unit(unit_of(df, one))._product(unit(unit_of(df, two)), sign)
    made = F.col(one) * F.col(two) if sign > 0 else F.col(one) / F.col(two)
    return df.withColumn(name, made).withMetadata(name, {"unit": u.text})
