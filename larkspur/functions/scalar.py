"""Scalar functions on double columns with IEEE results where Spark gives nulls or errors.

All propagate null, and everything is ``Column`` arithmetic.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")
#: From here on every double is a whole number.
WHOLE = float(1 << 52)


def divide(a: Column, b: Column) -> Column:
    """IEEE division: by zero gives an infinity, or NaN for 0 / 0."""
    return F.coalesce(F.try_divide(a, b), a * F.pow(b, F.lit(-1.0)))


def _guarded(x: Column, f: Column, least: float) -> Column:
    """A logarithm that is -inf at ``least`` and NaN below."""
    return F.when(x == least, F.lit(-INF)).when(x < least, F.lit(NAN)).otherwise(f)


def ln(x):
    return _guarded(x, F.ln(x), 0.0)


def log10(x):
    return _guarded(x, F.log10(x), 0.0)


def log2(x):
    return _guarded(x, F.log2(x), 0.0)


def log1p(x):
    return _guarded(x, F.log1p(x), -1.0)


def floor(x):
    return F.when(F.isnan(x) | (F.abs(x) >= WHOLE), x).otherwise(F.floor(x).cast("double"))


def ceil(x):
    return F.when(F.isnan(x) | (F.abs(x) >= WHOLE), x).otherwise(F.ceil(x).cast("double"))


def round_half_up(x):
    """Nearest whole number, halves upwards."""
    return F.when(F.isnan(x) | (F.abs(x) >= WHOLE), x).when(x - F.floor(x) < 0.5, F.floor(x).cast("double")).otherwise(F.ceil(x).cast("double"))


def trunc(x):
    return F.when(F.isnan(x) | (F.abs(x) >= WHOLE), x).otherwise(F.signum(x) * F.floor(F.abs(x)))


def asinh(x):
    return F.signum(x) * F.log1p(F.abs(x) + x * x / (1.0 + F.sqrt(x * x + 1.0)))


def atanh(x):
    return F.when(x == 1.0, F.lit(INF)).when(x == -1.0, F.lit(-INF)).otherwise(F.atanh(x))


def over(x):
    """1 / x."""
    return divide(F.lit(1.0), x)


def acoth(x):
    return 0.5 * ln(divide(x + 1.0, x - 1.0))


def relu(x):
    return F.when(x.isNull(), None).when((x > 0) & ~F.isnan(x), x).otherwise(F.lit(0.0))


def sigmoid(x):
    return divide(F.lit(1.0), 1.0 + F.exp(-x))


def _log_scaled_erfc(x: float) -> float:
    """ln(erfc(x) exp(x^2)), by its asymptotic series where erfc is too small."""
    if x < 20:
        return math.log(math.erfc(x)) + x * x
    term, total = 1.0, 1.0
    for n in range(1, 8):
        term *= -(2 * n - 1) / (2 * x * x)
        total += term
    return math.log(total / (x * math.sqrt(math.pi)))


def _erfc_fit(n: int = 26) -> list[float]:
    """Coefficients, in powers of y = 2t - 1 with t = 2 / (2 + x), of ln(erfc(x) / t) + x^2 for x >= 0: interpolation at Chebyshev's points."""
    y = np.cos(np.pi * (np.arange(n) + 0.5) / n)
    t = (y + 1) / 2
    values = [_log_scaled_erfc(2 / k - 2) - math.log(k) for k in t.tolist()]
    return np.polynomial.chebyshev.cheb2poly(np.polynomial.chebyshev.chebfit(y, values, n - 1)).tolist()


ERFC = _erfc_fit()
#: Coefficients of erf(x) / x in powers of x^2.
ERF = [2 / math.sqrt(math.pi) * (-1) ** n / (math.factorial(n) * (2 * n + 1)) for n in range(20)]


def _polynomial(coefficients: list[float], x: Column) -> Column:
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + F.lit(c)
    return out


def _upper(x: Column) -> Column:
    """erfc of numbers from 0."""
    t = 2.0 / (2.0 + x)
    return t * F.exp(_polynomial(ERFC, 2.0 * t - 1.0) - x * x)


def erf(x):
    far = F.signum(x) * (1.0 - _upper(F.abs(x)))
    return F.when(F.isnan(x), x).when(F.abs(x) < 1.0, x * _polynomial(ERF, x * x)).otherwise(far)


def erfc(x):
    far = F.when(x < 0, 2.0 - _upper(-x)).otherwise(_upper(x))
    return F.when(F.isnan(x), x).when(F.abs(x) < 0.5, 1.0 - x * _polynomial(ERF, x * x)).otherwise(far)


def gelu(x):
    return 0.5 * x * (1.0 + erf(x / math.sqrt(2.0)))


def gelu_tanh(x):
    return 0.5 * x * (1.0 + F.tanh(math.sqrt(2.0 / math.pi) * (x + 0.044715 * x * x * x)))


#: Functions of one number, by name.
UNARY = {
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "exp": F.exp, "ln": ln, "sqrt": F.sqrt, "asin": F.asin, "acos": F.acos, "atan": F.atan,
    "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "cot": lambda x: over(F.tan(x)), "sec": lambda x: over(F.cos(x)), "csc": lambda x: over(F.sin(x)),
    "asinh": asinh, "acosh": F.acosh, "atanh": atanh, "coth": lambda x: over(F.tanh(x)), "sech": lambda x: over(F.cosh(x)), "csch": lambda x: over(F.sinh(x)),
    "acot": lambda x: F.atan(over(x)), "asec": lambda x: F.acos(over(x)), "acsc": lambda x: F.asin(over(x)), "acoth": acoth,
    "asech": lambda x: F.acosh(over(x)), "acsch": lambda x: asinh(over(x)), "abs": F.abs, "log10": log10, "log2": log2, "cbrt": F.cbrt,
    "floor": floor, "ceil": ceil, "round": round_half_up, "sign": F.signum, "trunc": trunc, "expm1": F.expm1, "log1p": log1p,
    "sigmoid": sigmoid, "erf": erf, "relu": relu,
}
#: Further ones that traced and symbolic expressions know.
MORE_UNARY = {"log": ln, "neg": lambda x: -x, "gelu": gelu, "gelu_tanh": gelu_tanh, "erfc": erfc}


def least(a, b):
    """The left where it is not above, else the right; with a NaN on either side the right."""
    return F.when(a.isNull() | b.isNull(), None).when(~F.isnan(a) & ~F.isnan(b) & (a <= b), a).otherwise(b)


def greatest(a, b):
    return F.when(a.isNull() | b.isNull(), None).when(~F.isnan(a) & ~F.isnan(b) & (a >= b), a).otherwise(b)


#: Functions of two numbers.
BINARY = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": divide, "pow": F.pow, "atan2": F.atan2, "hypot": F.hypot, "min": least, "max": greatest,
}
