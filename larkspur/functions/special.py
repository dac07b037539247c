"""Special functions and distributions of columns: gamma and beta functions, complete and incomplete, and what is made of them.

All are ``Column`` expressions.  Series and continued fractions are folds whose number of steps grows with
the root of the parameters, up to ``TERMS``, which is enough for parameters of some millions; a null argument
gives null, one outside the domain NaN.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import erf

TERMS, HALVINGS = 20_000, 60
#: Stirling's series for the logarithm of the gamma function, B(2k) / (2k (2k - 1)).
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156, -3617 / 122400)
TINY = 1e-300
NAN = float("nan")


def number(x) -> Column:
    return x.cast("double") if isinstance(x, Column) else F.lit(float(x))


def let(make: Callable[..., Column], *values) -> Column:
    """``make`` of values that are evaluated once, however often the expression names them."""
    if not values:
        return make()
    return F.get(F.transform(F.array(number(values[0])), lambda v: let(lambda *rest: make(v, *rest), *values[1:])), F.lit(0))


def _fold(start: dict[str, Column], step: Callable[[Column, Column], dict[str, Column]], terms: Column | int) -> Column:
    pack = lambda d: F.struct(*[c.alias(n) for n, c in d.items()])
    return F.aggregate(F.sequence(F.lit(1), terms if isinstance(terms, Column) else F.lit(terms)), pack(start), lambda s, k: pack(step(s, k.cast("double"))))


def ln_gamma(x) -> Column:
    """Logarithm of the gamma function of positive numbers (+inf at 0): Stirling's series from 10 on, below it by the recurrence."""
    return let(_ln_gamma, x)


def _ln_gamma(x: Column) -> Column:
    low = F.greatest(F.lit(0.0), F.ceil(10 - x)).cast("double")
    y = x + low
    series = sum((F.lit(c) / F.pow(y, F.lit(2.0 * k + 1)) for k, c in enumerate(STIRLING)), F.lit(0.0))
    large = (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series
    steps = F.when(low > 0, F.sequence(F.lit(0), (low - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    shifted = large - F.ln(F.aggregate(steps, F.lit(1.0), lambda p, k: p * (x + k)))
    return F.when(x > 0, shifted).when(x == 0, F.lit(float("inf"))).when(x.isNotNull(), F.lit(NAN))


def gamma(x) -> Column:
    """Gamma function; negative numbers by reflection, NaN at 0, -1, -2, ..."""

    def make(x: Column) -> Column:
        mirror = F.sin(math.pi * x)
        below = F.when(x == F.floor(x), F.lit(NAN)).otherwise(math.pi / (mirror * F.exp(ln_gamma(1 - x))))
        return F.when(x > 0, F.exp(ln_gamma(x))).otherwise(below)

    return let(make, x)


def ln_beta(a, b) -> Column:
    return let(lambda a, b: ln_gamma(a) + ln_gamma(b) - ln_gamma(a + b), a, b)


def beta(a, b) -> Column:
    return F.exp(ln_beta(a, b))


def regularized_gamma_p(a, x) -> Column:
    """Lower incomplete gamma function over the complete one, for a > 0 and x >= 0."""
    return let(lambda a, x: _gamma_ratio(a, x, lower=True), a, x)


def regularized_gamma_q(a, x) -> Column:
    """One less ``regularized_gamma_p``, without cancellation in the upper tail."""
    return let(lambda a, x: _gamma_ratio(a, x, lower=False), a, x)


def _gamma_ratio(a: Column, x: Column, lower: bool) -> Column:
    front = F.exp(a * F.ln(x) - x - ln_gamma(a))
    terms = F.least(F.lit(TERMS), F.coalesce(F.ceil(90 + 10 * F.sqrt(F.abs(a))), F.lit(1))).cast("int")
    series = _fold({"t": 1 / a, "s": 1 / a}, lambda s, k: {"t": s["t"] * x / (a + k), "s": s["s"] + s["t"] * x / (a + k)}, terms)["s"] * front

    def step(s: Column, k: Column) -> dict[str, Column]:  # Lentz: f = c / d, level by level
        n, b = k * (a - k), x + 2 * k + 1 - a
        d, c = b + n * s["d"] + TINY, b + n / s["c"] + TINY  # never 0; each is named twice below, so no condition on them
        return {"f": s["f"] * (c / d), "c": c, "d": 1 / d}

    b0 = x + 1 - a
    fraction = _fold({"f": 1 / b0, "c": F.lit(1 / TINY), "d": 1 / b0}, step, terms)["f"] * front
    small = x < a + 1
    value = F.when(small, series if lower else 1 - series).otherwise(1 - fraction if lower else fraction)
    return F.when((a > 0) & (x > 0), value).when((a > 0) & (x == 0), F.lit(0.0 if lower else 1.0)).when(a.isNotNull() & x.isNotNull(), F.lit(NAN))


def regularized_beta(x, a, b) -> Column:
    """Incomplete beta function over the complete one, for 0 <= x <= 1 and positive a and b."""
    return let(_beta_ratio, x, a, b)


def _beta_ratio(x: Column, a: Column, b: Column) -> Column:
    def fraction(x: Column, a: Column, b: Column) -> Column:
        def step(s: Column, m: Column) -> dict[str, Column]:
            f, c, d = s["f"], s["c"], s["d"]
            for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 / (1 + n * d + TINY), 1 + n / c + TINY
                f = f * d * c
            return {"f": f, "c": c, "d": d}

        terms = F.least(F.lit(TERMS), F.coalesce(F.ceil(50 + 4 * F.sqrt(F.abs(F.greatest(a, b)))), F.lit(1))).cast("int")
        first = 1 / (1 - (a + b) * x / (a + 1))
        return _fold({"f": first, "c": F.lit(1.0), "d": first}, step, terms)["f"] * F.exp(a * F.ln(x) + b * F.ln(1 - x) - ln_beta(a, b)) / a

    value = F.when(x < (a + 1) / (a + b + 2), fraction(x, a, b)).otherwise(1 - fraction(1 - x, b, a))
    inside = (a > 0) & (b > 0)
    return F.when(inside & (x > 0) & (x < 1), value).when(inside & (x == 0), 0.0).when(inside & (x == 1), 1.0).when(x.isNotNull() & a.isNotNull() & b.isNotNull(), F.lit(NAN))


# --- distributions ---


@dataclass(frozen=True)
class Distribution:
    """Density (or mass), distribution function and quantile of a column; ``low`` and ``high`` bound the values, ``whole`` says whether they are whole numbers."""

    density: Callable[[Column], Column]
    below: Callable[[Column], Column]
    low: float = 0.0
    high: float = math.inf
    whole: bool = False

    def pdf(self, x) -> Column:
        def make(x: Column) -> Column:
            inside = (x >= self.low) & (x <= self.high)
            inside = inside & (x == F.floor(x)) if self.whole else inside
            return F.when(inside, self.density(x)).when(x.isNotNull(), 0.0)

        return let(make, x)

    def cdf(self, x) -> Column:
        def make(x: Column) -> Column:
            at = F.floor(x).cast("double") if self.whole else x
            return F.when(x < self.low, 0.0).when(x >= self.high, 1.0).when(x.isNotNull(), let(self.below, at))

        return let(make, x)

    def quantile(self, p) -> Column:
        """Where the distribution function reaches ``p`` (of 0 and 1: the bounds), by halving; of whole numbers the least at which it does."""
        return let(self._quantile, p)

    def _quantile(self, p: Column) -> Column:
        # y from 0 to 1 runs over the values; infinite ends by a rational map
        if math.isinf(self.low) and math.isinf(self.high):
            at = lambda y: (2 * y - 1) / (y * (1 - y))
        elif math.isinf(self.high):
            at = lambda y: self.low + y / (1 - y)
        else:
            at = lambda y: self.low + y * (self.high - self.low)

        def half(s: Column, k: Column) -> dict[str, Column]:  # a step up or none, so that the distribution function is evaluated once
            middle = s["a"] + s["step"]
            under = let(self.below, F.floor(at(middle)).cast("double") if self.whole else at(middle)) < p
            return {"a": s["a"] + F.when(under, s["step"]).otherwise(0.0), "step": s["step"] / 2}

        found = _fold({"a": F.lit(0.0), "step": F.lit(0.5)}, half, HALVINGS)["a"]
        value = let(lambda a: F.floor(at(a + 2.0**-HALVINGS) + 1e-9).cast("double"), found) if self.whole else let(lambda a: at(a + 2.0 ** -(HALVINGS + 1)), found)
        return F.when(p == 0, self.low).when(p == 1, self.high).when((p > 0) & (p < 1), value).when(p.isNotNull(), F.lit(NAN))


def normal(mean: float = 0.0, std: float = 1.0) -> Distribution:
    z = lambda x: (x - mean) / std
    # the tails by the incomplete gamma function, which keeps their digits
    tail = lambda t: regularized_gamma_q(0.5, t * t / 2) / 2
    return Distribution(lambda x: F.exp(-z(x) * z(x) / 2) / (std * math.sqrt(2 * math.pi)), lambda x: F.when(z(x) < -1, tail(z(x))).otherwise((1 + erf(z(x) / math.sqrt(2))) / 2), -math.inf, math.inf)


def exponential(rate: float) -> Distribution:
    return Distribution(lambda x: rate * F.exp(-rate * x), lambda x: -F.expm1(-rate * x))


def gamma_distribution(shape, scale: float = 1.0) -> Distribution:
    a = number(shape)
    return Distribution(lambda x: F.exp((a - 1) * F.ln(x / scale) - x / scale - ln_gamma(a)) / scale, lambda x: regularized_gamma_p(a, x / scale))


def chi_square(df) -> Distribution:
    return gamma_distribution(number(df) / 2, 2.0)


def beta_distribution(a, b) -> Distribution:
    a, b = number(a), number(b)
    return Distribution(lambda x: F.exp((a - 1) * F.ln(x) + (b - 1) * F.ln(1 - x) - ln_beta(a, b)), lambda x: regularized_beta(x, a, b), 0.0, 1.0)


def student_t(df) -> Distribution:
    v = number(df)
    half = lambda t: regularized_beta(v / (v + t * t), v / 2, 0.5) / 2
    near = lambda t: 0.5 + F.signum(t) / 2 * regularized_beta(t * t / (v + t * t), 0.5, v / 2)  # noqa: E731  # keeps the digits of small t
    return Distribution(lambda t: F.exp(-(v + 1) / 2 * F.log1p(t * t / v) - ln_beta(v / 2, 0.5)) / F.sqrt(v), lambda t: F.when(t * t < v, near(t)).when(t < 0, half(t)).otherwise(1 - half(t)), -math.inf, math.inf)


def f_distribution(one, two) -> Distribution:
    m, n = number(one), number(two)
    return Distribution(
        lambda x: F.exp(m / 2 * F.ln(m * x) + n / 2 * F.ln(n) - (m + n) / 2 * F.ln(m * x + n) - ln_beta(m / 2, n / 2)) / x, lambda x: regularized_beta(m * x / (m * x + n), m / 2, n / 2)
    )


def poisson(rate) -> Distribution:
    r = number(rate)
    return Distribution(lambda k: F.exp(k * F.ln(r) - r - ln_gamma(k + 1)), lambda k: regularized_gamma_q(k + 1, r), whole=True)


def binomial(n: int, p: float) -> Distribution:
    mass = lambda k: F.exp(ln_gamma(n + 1) - ln_gamma(k + 1) - ln_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    return Distribution(mass, lambda k: F.when(k >= n, 1.0).otherwise(regularized_beta(1 - p, n - k, k + 1)), 0.0, float(n), True)
