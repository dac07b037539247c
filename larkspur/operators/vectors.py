"""Tensors as vector columns: one ``array<double>`` a row.  Everything stays inside Spark's array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import scalar

NAN = float("nan")


def let(values: dict[str, Column], f) -> Column:
    """``f`` of a struct of values, each computed once however often ``f`` uses it."""
    return F.get(F.transform(F.array(F.struct(*[c.alias(n) for n, c in values.items()])), f), 0)


def unary(name: str, v: Column) -> Column:
    f = {**scalar.UNARY, **scalar.MORE_UNARY}[name]
    return F.transform(v, f)


def binary(name: str, a: Column, b) -> Column:
    """Element by element; ``b`` is a vector of the same length, or a number."""
    f = scalar.BINARY[name]
    if not isinstance(b, Column):
        return F.transform(a, lambda x: f(x, F.lit(float(b))))
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, f)).otherwise(F.raise_error(F.lit("vectors differ in length")))


COMPARISONS = {"eq": lambda x, y: x == y, "lt": lambda x, y: x < y, "le": lambda x, y: x <= y, "gt": lambda x, y: x > y, "ge": lambda x, y: x >= y}


def compare(name: str, a: Column, b) -> Column:
    """Booleans; NaN equals nothing and is not above or below anything."""
    other = b if isinstance(b, Column) else F.array_repeat(F.lit(float(b)), F.size(a))
    if name == "ne":
        return F.transform(compare("eq", a, b), lambda x: ~x)
    return F.zip_with(a, other, lambda x, y: COMPARISONS[name](x, y) & ~F.isnan(x) & ~F.isnan(y))


def where(condition: Column, a: Column, b: Column) -> Column:
    pairs = F.arrays_zip(condition.alias("c"), a.alias("a"), b.alias("b"))
    return F.transform(pairs, lambda t: F.when(t["c"], t["a"]).otherwise(t["b"]))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def product(v: Column) -> Column:
    return F.aggregate(v, F.lit(1.0), lambda s, x: s * x)


def mean(v: Column) -> Column:
    return scalar.divide(total(v), F.size(v).cast("double"))


def variance(v: Column, ddof: int = 0) -> Column:
    squares = let({"v": v, "m": mean(v)}, lambda t: F.aggregate(t["v"], F.lit(0.0), lambda s, x: s + (x - t["m"]) * (x - t["m"])))
    return F.when(F.size(v) > ddof, squares / (F.size(v) - ddof)).otherwise(F.raise_error(F.lit("too few elements")))


def std(v: Column, ddof: int = 0) -> Column:
    return F.sqrt(variance(v, ddof))


def extreme(v: Column, largest: bool) -> Column:
    """Minimum or maximum; any NaN gives NaN, an empty vector raises."""
    best = F.array_max(v) if largest else F.array_min(v)
    odd = F.exists(v, lambda x: F.isnan(x))
    return F.when(F.size(v) == 0, F.raise_error(F.lit("no elements"))).when(odd, F.lit(NAN)).otherwise(best)


def arg_extreme(v: Column, largest: bool) -> Column:
    """Index from 0 of the first minimum or maximum."""
    return (F.array_position(v, F.array_max(v) if largest else F.array_min(v)) - 1).cast("int")


def any_(v: Column) -> Column:
    return F.exists(v, lambda x: x != 0)


def all_(v: Column) -> Column:
    return F.forall(v, lambda x: x != 0)


def _scan(v: Column, start: float, f) -> Column:
    grown = F.aggregate(v, F.array().cast("array<double>"), lambda s, x: F.concat(s, F.array(f(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(start)), x))))
    return grown


def cumsum(v: Column) -> Column:
    return _scan(v, 0.0, lambda s, x: s + x)


def cumprod(v: Column) -> Column:
    return _scan(v, 1.0, lambda s, x: s * x)


def softmax(v: Column) -> Column:
    parts = let({"v": v, "top": F.array_max(v)}, lambda t: F.transform(t["v"], lambda x: F.exp(x - t["top"])))
    return let({"p": parts}, lambda t: let({"p": t["p"], "sum": total(t["p"])}, lambda u: F.transform(u["p"], lambda x: x / u["sum"])))


def dot(a: Column, b: Column) -> Column:
    return total(binary("mul", a, b))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    return scalar.divide(dot(a, b), norm(a) * norm(b))


def with_index(v: Column) -> Column:
    return F.transform(v, lambda x, i: F.struct(x.alias("value"), i.alias("index")))


def argsort(v: Column) -> Column:
    """Stable order of the elements."""
    return F.transform(F.array_sort(with_index(v)), lambda t: t["index"])


def top_k(v: Column, k: int, largest: bool = True) -> Column:
    """``array<struct<value, index>>``, first index first on ties; fewer than ``k`` elements raise."""
    signed = F.transform(v, lambda x, i: F.struct((-x if largest else x).alias("s"), i.alias("index"), x.alias("value")))
    best = F.transform(F.slice(F.array_sort(signed), 1, k), lambda t: F.struct(t["value"].alias("value"), t["index"].alias("index")))
    return F.when(F.size(v) >= k, best).otherwise(F.raise_error(F.lit("k is out of range")))


def roll(v: Column, shift: int) -> Column:
    n = F.greatest(F.size(v), F.lit(1))
    s = F.pmod(F.lit(-shift), n)
    return F.concat(F.slice(v, s + 1, F.size(v)), F.slice(v, F.lit(1), s))


def unfold(v: Column, width: int, step: int = 1) -> Column:
    """Windows of ``width`` neighbours, ``step`` apart."""
    last = F.floor((F.size(v) - width) / step).cast("int")
    return F.when(last < 0, F.array().cast("array<array<double>>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice(v, i * step + 1, F.lit(width))))


def pad(v: Column, before: int, after: int, value: float = 0.0) -> Column:
    fill = lambda n: F.array_repeat(F.lit(float(value)), n)
    return F.concat(fill(before), v, fill(after))


def clip(v: Column, low: float | None = None, high: float | None = None) -> Column:
    if low is not None:
        v = F.transform(v, lambda x: F.when(x < low, F.lit(float(low))).otherwise(x))
    if high is not None:
        v = F.transform(v, lambda x: F.when((x > high) & ~F.isnan(x), F.lit(float(high))).otherwise(x))
    return v


def take(v: Column, indices: list[int]) -> Column:
    """Elements by index, negative ones from the end; out of range raises."""
    return F.array(*[F.element_at(v, i + 1 if i >= 0 else i) for i in indices])


def slice_(v: Column, start: int | None = None, stop: int | None = None, step: int = 1) -> Column:
    """Python's slice of a vector."""
    at = lambda x, none: none if x is None else F.when(F.lit(x) < 0, F.greatest(F.size(v) + x, F.lit(0 if step > 0 else -1))).otherwise(F.least(F.lit(x), F.size(v) - (0 if step > 0 else 1)))
    a, b = (at(start, F.lit(0)), at(stop, F.size(v))) if step > 0 else (at(start, F.size(v) - 1), at(stop, F.lit(-1)))
    count = F.greatest(F.ceil((b - a) / F.lit(step)).cast("int"), F.lit(0))
    return F.when(count == 0, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.get(v, a + i * step)))


def normalize(v: Column, means: list[float], deviations: list[float]) -> Column:
    """Per-channel scaling of interleaved values."""
    if any(d == 0 for d in deviations):
        raise ValueError("a deviation is 0")
    m, d, n = F.array(*map(F.lit, means)), F.array(*map(F.lit, deviations)), len(means)
    return F.transform(v, lambda x, i: (x - F.get(m, i % n)) / F.get(d, i % n))


def convolve(a: Column, b: Column, mode: str = "full") -> Column:
    """Discrete convolution; ``same`` and ``valid`` are the middle of ``full``."""
    n, m = F.size(a), F.size(b)
    full = F.transform(
        F.sequence(F.lit(0), n + m - 2),
        lambda k: F.aggregate(F.sequence(F.greatest(F.lit(0), k - m + 1), F.least(k, n - 1)), F.lit(0.0), lambda s, i: s + F.get(a, i) * F.get(b, k - i)),
    )
    full = F.when((n == 0) | (m == 0), F.raise_error(F.lit("an empty operand"))).otherwise(full)
    if mode == "full":
        return full
    if mode == "same":
        return F.slice(full, F.floor((m - 1) / 2).cast("int") + 1, n)
    if mode == "valid":
        return F.slice(full, F.least(n, m), F.abs(n - m) + 1)
    raise ValueError(f"no mode {mode!r}")


def correlate(a: Column, b: Column, mode: str = "full") -> Column:
    return convolve(a, F.reverse(b), mode)
