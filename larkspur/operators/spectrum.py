"""Fourier transforms of series and matrices that no task holds, by four steps or more.

n = n1 * n2 numbers are seen as a matrix of n1 rows: its columns are transformed, a group of columns a
task; each entry is turned by a power of the n-th root of unity; and after a shuffle by row the rows
are transformed.  Longer series take more factors in the same way, a shuffle each.  Lengths with a
prime factor that is too large go through a convolution with a chirp, three transforms of a power of
two.  Tables are ``(i, re, im)``; numbers that are absent count as zero.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import checkpointed
from .ranges import running

#: Numbers of a row or column that a task transforms at once, and of a group of these.
MOST, GROUP = 1 << 20, 1 << 16
SCHEMA = "i long, re double, im double"


def factors(n: int, most: int = MOST) -> tuple[int, int] | None:
    """``n`` as a product of two numbers of up to ``most``, as near to each other as can be; None where there is none."""
    for a in range(math.isqrt(n), 0, -1):
        if n % a == 0:
            return (a, n // a) if n // a <= most else None
    return None


@functools.lru_cache(256)
def split(n: int, most: int = MOST) -> tuple[int, ...] | None:
    """``n`` as a product of as few numbers of up to ``most`` as can be, but two at least; None where a prime factor is above ``most``."""
    if n <= most * most and (pair := factors(n, most)):
        return pair
    divisors, rest = [a for a in range(2, min(n, most) + 1) if n % a == 0], n
    for a in divisors:
        while rest % a == 0:
            rest //= a
    if rest > 1:
        return None

    @functools.cache
    def parted(n: int, count: int) -> tuple[int, ...] | None:
        if n > most**count:
            return None
        if count == 2:
            return factors(n, most)
        return next(((a, *others) for a in divisors if a**count >= n and n % a == 0 and (others := parted(n // a, count - 1))), None)

    return next(found for count in range(3, n.bit_length() + 1) if (found := parted(n, count)))


def _lines(rows: DataFrame, line: str, place: str, n: int, make, group: int) -> DataFrame:
    """Transforms of lines: ``rows(line, place, re, im)``, the places of a line in one group; ``make(lines, matrix)`` returns columns."""
    each = max(1, group // n)

    def run(table: pa.Table) -> pa.Table:
        a, b = table[line].to_numpy(), table[place].to_numpy()
        held, which = np.unique(a, return_inverse=True)
        z = np.zeros((len(held), n), complex)
        z[which, b] = table["re"].to_numpy() + 1j * table["im"].to_numpy()
        i, out = make(held, z)
        return pa.table({"i": i.ravel(), "re": np.ascontiguousarray(out.real).ravel(), "im": np.ascontiguousarray(out.imag).ravel()})

    grouped = rows.select(F.floor(F.col(line) / each).cast("long").alias("g"), line, place, "re", "im")
    return grouped.groupBy("g").applyInArrow(run, SCHEMA)


def _steps(rows: DataFrame, n: int, parts: Sequence[int], inverse: bool, group: int) -> DataFrame:
    """``(i, re, im)``, ``i`` being line * n + place: transforms of lines ``rows(line, place, re, im)`` of ``n`` places, a shuffle for each of ``parts``, whose product is ``n``."""
    f, sign, i, place, rest = np.fft.ifft if inverse else np.fft.fft, 2j if inverse else -2j, F.col("i"), F.col("place"), n
    for part in parts[:-1]:
        rest //= part

        def columns(held: np.ndarray, z: np.ndarray, part=part, rest=rest):
            line, b, k, size = held // rest, held % rest, np.arange(part), part * rest
            turn = np.exp(sign * np.pi * ((b[:, None] * k) % size) / size)
            return (line * size + b)[:, None] + rest * k, f(z, axis=1) * turn

        apart = rows.select((F.col("line") * rest + place % rest).alias("line"), F.floor(place / rest).cast("long").alias("place"), "re", "im")
        made = _lines(apart, "line", "place", part, columns, group)
        rows = made.select(F.floor(i / rest).cast("long").alias("line"), (i % rest).alias("place"), "re", "im")

    def lines(held: np.ndarray, z: np.ndarray):
        first, step = 0, n // rest
        for part in reversed(parts[:-1]):  # the line's number has the places in all former parts as digits, the first one foremost; the result has it last
            step //= part
            held, k = np.divmod(held, part)
            first = first + k * step
        return (held * n + first)[:, None] + n // rest * np.arange(rest), f(z, axis=1)

    return _lines(rows, "line", "place", rest, lines, group)


def transform(rows: DataFrame, n: int, *, inverse: bool = False, most: int = MOST, group: int = GROUP) -> DataFrame:
    """``(i, re, im)``: the discrete Fourier transform (or its inverse) of ``rows(i, re, im)``, ``i`` from 0 to n - 1.  Two shuffles for lengths of up to ``most`` squared."""
    if n < 1:
        return rows.select("i", "re", "im").limit(0)
    parts = split(n, most)
    if parts is None:
        return _chirped(rows, n, inverse, most, group)
    return _steps(rows.select(F.lit(0).cast("long").alias("line"), F.col("i").alias("place"), "re", "im"), n, parts, inverse, group)


def transform_lines(rows: DataFrame, n: int, *, inverse: bool = False, most: int = MOST, group: int = GROUP) -> DataFrame:
    """``(i, re, im)`` of many lines ``rows(line, place, re, im)`` of ``n`` places, ``i`` being line * n + place: one shuffle where a line fits a group, else the steps."""
    parts = (n,) if n <= group else split(n, most)
    if parts is None:
        raise ValueError(f"{n} is no product of numbers of up to {most}")
    return _steps(rows, n, parts, inverse, group)


def _times(a: tuple[Column, Column], b: tuple[Column, Column]) -> list[Column]:
    return [(a[0] * b[0] - a[1] * b[1]).alias("re"), (a[0] * b[1] + a[1] * b[0]).alias("im")]


def _product(one: DataFrame, two: DataFrame) -> DataFrame:
    other = two.select("i", F.col("re").alias("r2"), F.col("im").alias("i2"))
    return one.join(other, "i").select("i", *_times((F.col("re"), F.col("im")), (F.col("r2"), F.col("i2"))))


def _chirped(rows: DataFrame, n: int, inverse: bool, most: int, group: int) -> DataFrame:
    if n >= 1 << 31:
        raise ValueError("longer series need a length with factors")
    m = 1 << (2 * n - 2).bit_length()

    def chirp(i: Column, sign: float) -> tuple[Column, Column]:
        angle = F.pmod(i * i, F.lit(2 * n)) * (sign * math.pi / n)
        return F.cos(angle), F.sin(angle)

    sign, i = (1.0 if inverse else -1.0), F.col("i")
    turned = rows.select("i", *_times((F.col("re"), F.col("im")), chirp(i, sign)))
    near = F.least(i, F.lit(m) - i)
    wave = rows.sparkSession.range(m).select(F.col("id").alias("i")).where((i < n) | (i > m - n))
    re, im = chirp(near, -sign)
    both = _product(transform(turned, m, most=most, group=group), transform(wave.select("i", re.alias("re"), im.alias("im")), m, most=most, group=group))
    back = transform(both, m, inverse=True, most=most, group=group).where(i < n)
    scale = F.lit(1.0 / n if inverse else 1.0)
    return back.select("i", *[(c * scale).alias(name) for c, name in zip(_times((F.col("re"), F.col("im")), chirp(i, sign)), ("re", "im"))])


def series(df: DataFrame, time: str, value: str) -> tuple[DataFrame, int]:
    """The table of a series ``(i, re, im)`` in order of time, and its length; nulls count as 0."""
    rows = df.select(F.col(time).alias("t"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("re"))
    held = checkpointed(running(rows, "t", "i").select("i", "re", F.lit(0.0).alias("im")))
    return held, held.count()


def fft(df: DataFrame, time: str, value: str, *, padded: bool = False, one_sided: bool = False, most: int = MOST) -> DataFrame:
    """``(i, re, im)``: spectrum of one series of any length (with zeros up to a power of two if ``padded``; up to half the rate if ``one_sided``)."""
    rows, n = series(df, time, value)
    n = 1 << max(0, n - 1).bit_length() if padded and n else n
    made = transform(rows, n, most=most)
    return made.where(F.col("i") <= n // 2) if one_sided else made


def inverse(spectrum: DataFrame, n: int, *, one_sided: bool = False, most: int = MOST) -> DataFrame:
    """``(i, re, im)`` of a spectrum of ``n`` numbers; of a one-sided one the other half is filled in."""
    if one_sided:
        other = spectrum.where((F.col("i") > 0) & (2 * F.col("i") < n)).select((F.lit(n) - F.col("i")).alias("i"), "re", (-F.col("im")).alias("im"))
        spectrum = spectrum.unionByName(other)
    return transform(spectrum, n, inverse=True, most=most)


def fft2(cells: DataFrame, shape: Sequence[int], *, back: bool = False, group: int = GROUP) -> DataFrame:
    """``(i0, i1, re, im)``: two-dimensional transform of cells ``(i0, i1, re, im)``; a row or column is held by one task."""
    rows, columns = map(int, shape)
    f = np.fft.ifft if back else np.fft.fft
    i = F.col("i")
    first = _lines(cells, "i0", "i1", columns, lambda a, z: (a[:, None] * columns + np.arange(columns), f(z, axis=1)), group)
    both = _lines(first.select(F.floor(i / columns).cast("long").alias("i0"), (i % columns).alias("i1"), "re", "im"), "i1", "i0", rows, lambda b, z: (b[:, None] + columns * np.arange(rows), f(z, axis=1)), group)
    return both.select(F.floor(i / columns).cast("long").alias("i0"), (i % columns).alias("i1"), "re", "im")


def convolved(one: tuple[DataFrame, int], two: tuple[DataFrame, int], *, most: int = MOST) -> DataFrame:
    """``(i, x)``: full convolution of two series (each a table and its length), neither of which fits a task."""
    (a, n), (b, m) = one, two
    if not n or not m:
        return a.select("i", F.col("re").alias("x")).limit(0)
    size = 1 << (n + m - 2).bit_length()
    both = _product(transform(a, size, most=most), transform(b, size, most=most))
    return transform(both, size, inverse=True, most=most).where(F.col("i") < n + m - 1).select("i", F.col("re").alias("x"))


#: Coefficients of the cosine windows.
COSINES = {"boxcar": (1.0,), "hann": (0.5, 0.5), "hamming": (0.54, 0.46), "blackman": (0.42, 0.5, 0.08)}


def periodogram(df: DataFrame, time: str, value: str, *, rate: float = 1.0, window: str = "boxcar", detrend: str | None = "constant", scaling: str = "density", most: int = MOST) -> DataFrame:
    """``(bin, frequency, power)``: one-sided power of a whole series of any length in one stretch.

    ``detrend`` takes the mean ("constant") or the least-squares line ("linear") away first.
    """
    rows, n = series(df, time, value)
    if not n:
        return rows.select(F.col("i").alias("bin"), F.col("re").alias("frequency"), F.col("im").alias("power"))
    i, x = F.col("i"), F.col("re")
    if detrend == "constant":
        x = x - F.lit(rows.agg(F.avg("re")).first()[0])
    elif detrend == "linear":
        slope, start = rows.agg(F.coalesce(F.regr_slope("re", "i"), F.lit(0.0)), F.coalesce(F.regr_intercept("re", "i"), F.avg("re"))).first()
        x = x - (F.lit(start) + F.lit(slope) * i)
    elif detrend is not None:
        raise ValueError(f"no detrending {detrend!r}")
    weight = sum((F.lit((-1.0) ** k * c) * F.cos(i * (2 * math.pi * k / n)) for k, c in enumerate(COSINES[window])), F.lit(0.0))
    parts = COSINES[window]
    height = n * parts[0] if n > 2 * len(parts) else float(rows.agg(F.sum(weight)).first()[0])
    squares = n * (parts[0] ** 2 + sum(c * c for c in parts[1:]) / 2) if n > 2 * len(parts) else float(rows.agg(F.sum(weight * weight)).first()[0])
    scale = 1 / (rate * squares) if scaling == "density" else 1 / height**2
    made = transform(rows.select("i", (x * weight).alias("re"), "im"), n, most=most).where(i <= n // 2)
    twice = F.when((i == 0) | (2 * i == n), 1.0).otherwise(2.0)
    return made.select(i.alias("bin"), (i * rate / n).alias("frequency"), ((F.col("re") * F.col("re") + F.col("im") * F.col("im")) * twice * scale).alias("power"))
