"""Functions of numbers traced into columns: a value, and its derivative by each input (forward mode).

``compiled`` calls a Python function once on symbols; what it returns is a ``Column`` that code generation
fuses with the rest of the plan.  ``parsed`` reads an arithmetic expression the same way.
"""

from __future__ import annotations

import ast
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scalar


@dataclass(frozen=True, eq=False)
class Traced:
    value: Column
    slopes: tuple  # by input

    def _chain(self, value: Column, factor: Column) -> Traced:
        return Traced(value, tuple(s * factor for s in self.slopes))

    def __add__(self, other):
        o = lift(other, len(self.slopes))
        return Traced(self.value + o.value, tuple(a + b for a, b in zip(self.slopes, o.slopes)))

    __radd__ = __add__

    def __neg__(self):
        return self._chain(-self.value, F.lit(-1.0))

    def __sub__(self, other):
        return self + -lift(other, len(self.slopes))

    def __rsub__(self, other):
        return -self + other

    def __mul__(self, other):
        o = lift(other, len(self.slopes))
        return Traced(self.value * o.value, tuple(a * o.value + b * self.value for a, b in zip(self.slopes, o.slopes)))

    __rmul__ = __mul__

    def __truediv__(self, other):
        o = lift(other, len(self.slopes))
        q = scalar.divide(self.value, o.value)
        return Traced(q, tuple(scalar.divide(a - q * b, o.value) for a, b in zip(self.slopes, o.slopes)))

    def __rtruediv__(self, other):
        return lift(other, len(self.slopes)) / self

    def __pow__(self, n):
        if isinstance(n, Traced):
            y = F.pow(self.value, n.value)
            return Traced(y, tuple(a * n.value * F.pow(self.value, n.value - 1) + b * y * scalar.ln(self.value) for a, b in zip(self.slopes, n.slopes)))
        return self._chain(F.pow(self.value, F.lit(float(n))), n * F.pow(self.value, F.lit(float(n - 1))))

    def compare(self, other, op: str) -> Traced:
        """1 or 0."""
        o = lift(other, len(self.slopes))
        a, b = self.value, o.value
        made = {"lt": a < b, "le": a <= b, "gt": a > b, "ge": a >= b, "eq": a == b, "ne": a != b}[op]
        made = made & ~F.isnan(a) & ~F.isnan(b) if op != "ne" else made | F.isnan(a) | F.isnan(b)
        return Traced(made.cast("double"), tuple(F.lit(0.0) for _ in self.slopes))

    def __lt__(self, o):
        return self.compare(o, "lt")

    def __le__(self, o):
        return self.compare(o, "le")

    def __gt__(self, o):
        return self.compare(o, "gt")

    def __ge__(self, o):
        return self.compare(o, "ge")


def lift(x, n: int) -> Traced:
    return x if isinstance(x, Traced) else Traced(F.lit(float(x)), tuple(F.lit(0.0) for _ in range(n)))


def select(condition: Traced, yes, no) -> Traced:
    n = len(condition.slopes)
    a, b = lift(yes, n), lift(no, n)
    pick = lambda p, q: F.when(condition.value != 0, p).otherwise(q)
    return Traced(pick(a.value, b.value), tuple(pick(p, q) for p, q in zip(a.slopes, b.slopes)))


ONE = lambda x: F.lit(1.0)
#: Slope of each function of one number, from its argument and its value.
SLOPES = {
    "sin": lambda x, y: F.cos(x), "cos": lambda x, y: -F.sin(x), "tan": lambda x, y: 1 + y * y, "exp": lambda x, y: y, "ln": lambda x, y: scalar.over(x), "sqrt": lambda x, y: scalar.divide(F.lit(0.5), y),
    "asin": lambda x, y: scalar.over(F.sqrt(1 - x * x)), "acos": lambda x, y: -scalar.over(F.sqrt(1 - x * x)), "atan": lambda x, y: scalar.over(1 + x * x), "sinh": lambda x, y: F.cosh(x), "cosh": lambda x, y: F.sinh(x),
    "tanh": lambda x, y: 1 - y * y, "asinh": lambda x, y: scalar.over(F.sqrt(x * x + 1)), "acosh": lambda x, y: scalar.over(F.sqrt(x * x - 1)), "atanh": lambda x, y: scalar.over(1 - x * x), "cot": lambda x, y: -1 - y * y,
    "sec": lambda x, y: y * F.tan(x), "csc": lambda x, y: -y * scalar.over(F.tan(x)), "coth": lambda x, y: 1 - y * y, "sech": lambda x, y: -y * F.tanh(x), "csch": lambda x, y: -y * scalar.over(F.tanh(x)),
    "acot": lambda x, y: -scalar.over(1 + x * x), "asec": lambda x, y: scalar.over(F.abs(x) * F.sqrt(x * x - 1)), "acsc": lambda x, y: -scalar.over(F.abs(x) * F.sqrt(x * x - 1)), "acoth": lambda x, y: scalar.over(1 - x * x),
    "asech": lambda x, y: -scalar.over(x * F.sqrt(1 - x * x)), "acsch": lambda x, y: -scalar.over(F.abs(x) * F.sqrt(1 + x * x)), "abs": lambda x, y: F.signum(x), "log10": lambda x, y: scalar.over(x * math.log(10)),
    "log2": lambda x, y: scalar.over(x * math.log(2)), "cbrt": lambda x, y: scalar.over(3 * y * y), "expm1": lambda x, y: y + 1, "log1p": lambda x, y: scalar.over(1 + x), "sigmoid": lambda x, y: y * (1 - y),
    "erf": lambda x, y: 2 / math.sqrt(math.pi) * F.exp(-x * x), "relu": lambda x, y: F.when((x > 0) & ~F.isnan(x), 1.0).otherwise(0.0), "neg": lambda x, y: F.lit(-1.0), "log": lambda x, y: scalar.over(x),
    "gelu": lambda x, y: 0.5 * (1 + scalar.erf(x / math.sqrt(2))) + x * F.exp(-x * x / 2) / math.sqrt(2 * math.pi), "floor": lambda x, y: F.lit(0.0), "ceil": lambda x, y: F.lit(0.0), "round": lambda x, y: F.lit(0.0),
    "trunc": lambda x, y: F.lit(0.0), "sign": lambda x, y: F.lit(0.0),
}


def apply(name: str, x: Traced) -> Traced:
    f = {**scalar.UNARY, **scalar.MORE_UNARY}[name]
    y = f(x.value)
    return x._chain(y, SLOPES[name](x.value, y))


#: Slopes of each function of two numbers by its first and second argument, from both and its value.
PAIR_SLOPES = {
    "atan2": (lambda a, b, y: scalar.divide(b, a * a + b * b), lambda a, b, y: scalar.divide(-a, a * a + b * b)),
    "hypot": (lambda a, b, y: scalar.divide(a, y), lambda a, b, y: scalar.divide(b, y)),
    "min": (lambda a, b, y: (a <= b).cast("double"), lambda a, b, y: (a > b).cast("double")),
    "max": (lambda a, b, y: (a >= b).cast("double"), lambda a, b, y: (a < b).cast("double")),
}


def apply_pair(name: str, a: Traced, b: Traced) -> Traced:
    """``atan2``, ``hypot``, ``min`` or ``max``; of equal values the first one's slope counts."""
    y = scalar.BINARY[name](a.value, b.value)
    da, db = (f(a.value, b.value, y) for f in PAIR_SLOPES[name])
    return Traced(y, tuple(p * da + q * db for p, q in zip(a.slopes, b.slopes)))


def compiled(f: Callable, inputs: list[Column]) -> Traced:
    """Value and slopes of ``f`` at the inputs."""
    n = len(inputs)
    return lift(f(*[Traced(c, tuple(F.lit(1.0 if i == k else 0.0) for i in range(n))) for k, c in enumerate(inputs)]), n)


def parsed(text: str, columns: dict[str, Column]) -> Traced:
    """An arithmetic expression over named columns: + - * / ^, comparisons, functions by name, and ``if`` as ``piecewise(condition, yes, no)``."""
    names = list(columns)
    known = dict(zip(names, [Traced(columns[n], tuple(F.lit(1.0 if i == k else 0.0) for i in range(len(names)))) for k, n in enumerate(names)]))
    constants = {"pi": math.pi, "e": math.e}
    operators = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: a / b, ast.Pow: lambda a, b: a**b}
    comparisons = {ast.Lt: "lt", ast.LtE: "le", ast.Gt: "gt", ast.GtE: "ge", ast.Eq: "eq", ast.NotEq: "ne"}

    def walk(node):
        match node:
            case ast.Constant(value=v) if isinstance(v, (int, float)) and not isinstance(v, bool):
                return float(v)
            case ast.Name(id=n) if n in known:
                return known[n]
            case ast.Name(id=n) if n in constants:
                return constants[n]
            case ast.BinOp(left=a, op=op, right=b) if type(op) in operators:
                x, y = walk(a), walk(b)
                if isinstance(op, ast.Pow) and isinstance(y, Traced):
                    x = lift(x, len(names))
                return operators[type(op)](x, y)
            case ast.UnaryOp(op=ast.USub(), operand=a):
                return -walk(a)
            case ast.Compare(left=a, ops=[op], comparators=[b]) if type(op) in comparisons:
                return lift(walk(a), len(names)).compare(walk(b), comparisons[type(op)])
            case ast.Call(func=ast.Name(id="piecewise"), args=[c, a, b], keywords=[]):
                return select(walk(c), walk(a), walk(b))
            case ast.Call(func=ast.Name(id=n), args=[a], keywords=[]) if n in SLOPES:
                return apply(n, lift(walk(a), len(names)))
            case ast.Call(func=ast.Name(id=n), args=[a, b], keywords=[]) if n in PAIR_SLOPES:
                return apply_pair(n, lift(walk(a), len(names)), lift(walk(b), len(names)))
        raise ValueError(f"not understood: {ast.unparse(node)}")

    return lift(walk(ast.parse(text.replace("^", "**"), mode="eval").body), len(names))
