"""Complex tensors in coordinate form: a ``DataFrame`` of cells ``(i0, i1, ..., re, im)``, each cell once.

Arithmetic with broadcasting is a join on the axes that both sides span, as in ``coordinates``; transforms
along an axis hold a line in one task, or go by four steps and two shuffles where a line is longer.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from math import prod

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spectrum
from .coordinates import OUTER, Cells, axis_names

Pair = tuple[Column, Column]


def _divided(a: Pair, b: Pair) -> Pair:
    """Quotient with the larger part of the divisor taken out first, so that squares don't overflow; by zero it is NaN."""
    top = F.greatest(F.abs(b[0]), F.abs(b[1]))
    scale = F.when(top > 0, top).otherwise(F.lit(float("nan")))
    c, d = b[0] / scale, b[1] / scale
    square = c * c + d * d
    return (a[0] * c + a[1] * d) / square / scale, (a[1] * c - a[0] * d) / square / scale


BINARY: dict[str, Callable[[Pair, Pair], Pair]] = {
    "add": lambda a, b: (a[0] + b[0], a[1] + b[1]),
    "sub": lambda a, b: (a[0] - b[0], a[1] - b[1]),
    "mul": lambda a, b: (a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]),
    "div": _divided,
}
UNARY: dict[str, Callable[[Column, Column], Pair]] = {
    "conj": lambda re, im: (re, -im),
    "neg": lambda re, im: (-re, -im),
    "exp": lambda re, im: (F.exp(re) * F.cos(im), F.exp(re) * F.sin(im)),
    "turn": lambda re, im: (-im, re),
}
REAL: dict[str, Callable[[Column, Column], Column]] = {
    "re": lambda re, im: re,
    "im": lambda re, im: im,
    "abs": F.hypot,
    "arg": lambda re, im: F.atan2(im, re),
    "power": lambda re, im: re * re + im * im,
}


@dataclass(frozen=True)
class ComplexCells:
    df: DataFrame
    shape: tuple

    @property
    def axes(self) -> list[str]:
        return axis_names(len(self.shape))

    def _axis(self, axis: int) -> int:
        if not -len(self.shape) <= axis < len(self.shape):
            raise IndexError(f"no axis {axis}")
        return axis % len(self.shape)

    def part(self, name: str) -> Cells:
        """Real cells: re, im, abs, arg (in turns of 2 pi, from -pi to pi) or power (the square of abs)."""
        return Cells(self.df.select(*self.axes, REAL[name](F.col("re"), F.col("im")).alias("v")), self.shape)

    def apply(self, name: str) -> ComplexCells:
        """conj, neg, exp or turn (times the imaginary unit) of each cell."""
        re, im = UNARY[name](F.col("re"), F.col("im"))
        return ComplexCells(self.df.select(*self.axes, re.alias("re"), im.alias("im")), self.shape)

    def combine(self, name: str, other: ComplexCells | complex) -> ComplexCells:
        """add, sub, mul or div, with a number or with cells whose axes have this size or 1; cells that have no partner are left out."""
        f, here = BINARY[name], (F.col("re"), F.col("im"))
        if not isinstance(other, ComplexCells):
            number = complex(other)
            re, im = f(here, (F.lit(number.real), F.lit(number.imag)))
            return ComplexCells(self.df.select(*self.axes, re.alias("re"), im.alias("im")), self.shape)
        if len(self.shape) != len(other.shape) or any(a != b and 1 not in (a, b) for a, b in zip(self.shape, other.shape)):
            raise ValueError(f"{self.shape} doesn't fit {other.shape}")
        shape = tuple(0 if 0 in (a, b) else max(a, b) for a, b in zip(self.shape, other.shape))
        right = other.df.select(*[F.col(n).alias(f"j{k}") for k, n in enumerate(other.axes)], F.col("re").alias("re2"), F.col("im").alias("im2"))
        both = [k for k, (a, b) in enumerate(zip(self.shape, other.shape)) if a == b]
        spanned = [k for k in both if self.shape[k] > 1]
        if not spanned and prod(self.shape) > 1 and prod(other.shape) > 1 and prod(shape) > OUTER:
            raise ValueError(f"an outer product of {prod(shape)} cells; the most is {OUTER}")
        on = [F.col(f"i{k}") == F.col(f"j{k}") for k in both]
        joined = self.df.join(right, on) if on else self.df.crossJoin(right)
        index = [F.col(f"i{k}" if self.shape[k] >= other.shape[k] else f"j{k}").alias(f"i{k}") for k in range(len(shape))]
        re, im = f(here, (F.col("re2"), F.col("im2")))
        return ComplexCells(joined.select(*index, re.alias("re"), im.alias("im")), shape)

    def shift(self, axes: Sequence[int] | None = None, back: bool = False) -> ComplexCells:
        """Zero frequency to the middle of the axes (all by default), or ``back`` to their start."""
        moved = {}
        for k in range(len(self.shape)) if axes is None else map(self._axis, axes):
            n = self.shape[k]
            by = -(n // 2) if back else n // 2
            moved[f"i{k}"] = F.pmod(F.col(f"i{k}") + by, F.lit(n)).cast("long")
        return ComplexCells(self.df.withColumns(moved), self.shape)

    def fft(self, axis: int, *, inverse: bool = False, most: int = spectrum.MOST, group: int = spectrum.GROUP) -> ComplexCells:
        """Transform along an axis; absent cells count as zero, lines without cells stay absent.

        A line of up to ``group`` cells is one task's; longer ones go by four steps or more, for which the size
        needs factors of up to ``most``.
        """
        axis = self._axis(axis)
        n, line = self.shape[axis], F.lit(0).cast("long")
        others = [k for k in range(len(self.shape)) if k != axis]
        for k in others:
            line = line * self.shape[k] + F.col(f"i{k}")
        rows = self.df.select(line.alias("line"), F.col(f"i{axis}").alias("place"), "re", "im")
        made = spectrum.transform_lines(rows, n, inverse=inverse, most=most, group=group)
        index, left = {f"i{axis}": (F.col("i") % n).cast("long")}, F.floor(F.col("i") / n).cast("long")
        for k in reversed(others):
            index[f"i{k}"] = (left % self.shape[k]).cast("long")
            left = F.floor(left / self.shape[k]).cast("long")
        return ComplexCells(made.select(*[index[a].alias(a) for a in self.axes], "re", "im"), self.shape)

    def fft_all(self, axes: Sequence[int] | None = None, *, inverse: bool = False, most: int = spectrum.MOST, group: int = spectrum.GROUP) -> ComplexCells:
        """Transforms along several axes (all by default), one after the other."""
        out = self
        for k in range(len(self.shape)) if axes is None else axes:
            out = out.fft(k, inverse=inverse, most=most, group=group)
        return out

    def reduce(self, how: str, axis: int | None = None) -> ComplexCells:
        """sum or mean, along an axis or over all cells."""
        f = {"sum": F.sum, "mean": F.avg}[how]
        keep = [] if axis is None else [k for k in range(len(self.shape)) if k != self._axis(axis)]
        made = self.df.groupBy(*[F.col(f"i{k}").alias(f"i{n}") for n, k in enumerate(keep)]).agg(f("re").alias("re"), f("im").alias("im"))
        return ComplexCells(made, tuple(self.shape[k] for k in keep))

    def to_array(self, most: int = 1_000_000) -> np.ndarray:
        """All values on the driver, absent cells as 0; more than ``most`` raise."""
        return self.part("re").to_array(most) + 1j * self.part("im").to_array(most)


def from_parts(real: Cells, imaginary: Cells | None = None) -> ComplexCells:
    """Complex cells of real ones; without ``imaginary`` (or where it has no cell) the other part is 0."""
    if imaginary is None:
        return ComplexCells(real.df.select(*real.axes, F.col("v").cast("double").alias("re"), F.lit(0.0).alias("im")), real.shape)
    if real.shape != imaginary.shape:
        raise ValueError(f"{real.shape} isn't {imaginary.shape}")
    joined = real.df.withColumnRenamed("v", "re").join(imaginary.df.withColumnRenamed("v", "im"), real.axes, "full")
    return ComplexCells(joined.select(*real.axes, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("re", "im")]), real.shape)
