"""Models fitted by gradient descent where a step's gradient is one Spark aggregate over all rows.

Optimizers hold their state on the driver, a few numbers a weight; rows never leave their tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from . import vectors as V
from .coordinates import Cells, unit_random

# --- losses, as aggregates ---


def mse(prediction: Column, target: Column) -> Column:
    return F.avg((prediction - target) * (prediction - target))


def huber(prediction: Column, target: Column, delta: float = 1.0) -> Column:
    d = F.abs(prediction - target)
    return F.avg(F.when(d <= delta, 0.5 * d * d).otherwise(delta * (d - 0.5 * delta)))


def binary_cross_entropy(logit: Column, target: Column) -> Column:
    return F.avg(F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit))))


def cross_entropy(logits: Column, label: Column) -> Column:
    log_sum = V.let({"v": logits, "top": F.array_max(logits)}, lambda t: t["top"] + F.ln(F.aggregate(t["v"], F.lit(0.0), lambda s, x: s + F.exp(x - t["top"]))))
    return F.avg(log_sum - F.get(logits, label))


# --- layers of vector columns, for inference ---


def linear(x: Column, weight: np.ndarray, bias: np.ndarray | None = None) -> Column:
    """Rows of ``weight`` times x, plus bias; weights are literals of the plan."""
    rows = F.array(*[F.array(*map(F.lit, r.tolist())) for r in weight])
    out = F.transform(rows, lambda r: V.dot(r, x))
    return out if bias is None else V.binary("add", out, F.array(*map(F.lit, bias.tolist())))


def layer_norm(x: Column, eps: float = 1e-5) -> Column:
    return V.let({"x": x, "m": V.mean(x), "s": F.sqrt(V.variance(x) + eps)}, lambda t: F.transform(t["x"], lambda v: (v - t["m"]) / t["s"]))


def embedding(df: DataFrame, table: DataFrame, key: str, name: str = "embedding") -> DataFrame:
    """Vectors by id from ``table(id, vector)``."""
    return df.join(table.select(F.col("id").alias(key), F.col("vector").alias(name)), key, "left")


def geglu(x: Column, gate: Column) -> Column:
    return F.zip_with(x, gate, lambda a, b: a * scalar.gelu_tanh(b))


def rotary(x: Column, position: Column, base: float = 10_000.0) -> Column:
    """Rotary position embedding of a vector of even size: its halves turned by angles that fall with the index."""
    half = F.floor(F.size(x) / 2).cast("int")
    angle = lambda i: position.cast("double") * F.pow(F.lit(base), -2.0 * (i % half) / F.size(x))
    partner = lambda i: F.when(i < half, -F.get(x, i + half)).otherwise(F.get(x, i - half))
    return F.transform(x, lambda v, i: v * F.cos(angle(i)) + partner(i) * F.sin(angle(i)))


def attention(query: Cells, key: Cells, value: Cells) -> Cells:
    """softmax(Q K' / sqrt(d)) V of matrices in coordinate form: two joins with sums and a window along the keys."""
    turned = key.permute(*range(len(key.shape) - 2), len(key.shape) - 1, len(key.shape) - 2)
    return query.matmul(turned).combine("div", float(np.sqrt(query.shape[-1]))).softmax(-1).matmul(value)


def dropout(x: Column, share: float, seed: int, row: Column) -> Column:
    """Zeroes a share (0 to below 1) of elements, chosen by the digest of seed, row and place, and scales the rest."""
    if not 0 <= share < 1:
        raise ValueError("the share is from 0 to below 1")
    keep = lambda i: unit_random(seed, F.concat_ws(":", row.cast("string"), i.cast("string"))) >= share
    return F.transform(x, lambda v, i: F.when(keep(i), v / (1 - share)).otherwise(F.lit(0.0)))


def sequential(*layers: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Functions of vector columns one after the other; what each gives is evaluated once."""

    def bound(layer: Callable[[Column], Column], x: Column) -> Column:
        return V.let({"x": x}, lambda t: layer(t["x"]))

    return lambda x: reduce(lambda made, layer: bound(layer, made), layers, x)


# --- optimizers ---


@dataclass
class SGD:
    rate: float
    momentum: float = 0.0
    nesterov: bool = False
    state: np.ndarray | None = None

    def step(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        if not self.momentum:
            return w - self.rate * g
        self.state = g if self.state is None else self.momentum * self.state + g
        return w - self.rate * (g + self.momentum * self.state if self.nesterov else self.state)


@dataclass
class Adam:
    rate: float = 1e-3
    betas: tuple = (0.9, 0.999)
    eps: float = 1e-8
    decay: float = 0.0  # decoupled from the gradient
    moments: list = field(default_factory=list)
    steps: int = 0

    def step(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        if not self.moments:
            self.moments = [np.zeros_like(w), np.zeros_like(w)]
        self.steps += 1
        a, b = self.betas
        self.moments[0] = a * self.moments[0] + (1 - a) * g
        self.moments[1] = b * self.moments[1] + (1 - b) * g * g
        m, v = self.moments[0] / (1 - a**self.steps), self.moments[1] / (1 - b**self.steps)
        return w * (1 - self.rate * self.decay) - self.rate * m / (np.sqrt(v) + self.eps)


@dataclass
class RMSprop:
    rate: float = 1e-2
    alpha: float = 0.99
    eps: float = 1e-8
    state: np.ndarray | None = None

    def step(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        self.state = (1 - self.alpha) * g * g if self.state is None else self.alpha * self.state + (1 - self.alpha) * g * g
        return w - self.rate * g / (np.sqrt(self.state) + self.eps)


def fit(df: DataFrame, columns: list[str], target: str, optimizer, *, logistic: bool = False, rounds: int = 100, schedule: Callable[[int], float] | None = None, report: Callable[[dict], None] | None = None) -> np.ndarray:
    """Weights (the last is the intercept) of a linear or logistic model; each round is one pass of sums.  ``report`` gets an event a round."""
    rows = df.select(*[F.col(c).cast("double") for c in columns], F.col(target).cast("double").alias("__y")).persist()
    w, base = np.zeros(len(columns) + 1), getattr(optimizer, "rate", None)
    for k in range(rounds):
        score = F.lit(float(w[-1]))
        for c, v in zip(columns, w):
            score = score + F.col(c) * float(v)
        miss = (scalar.sigmoid(score) if logistic else score) - F.col("__y")
        row = rows.agg(*[F.avg(miss * F.col(c)).alias(f"g{i}") for i, c in enumerate(columns)], F.avg(miss).alias("g")).first()
        g = np.array([v or 0.0 for v in row]) * (1 if logistic else 2)
        if schedule:
            optimizer.rate = base * schedule(k)
        w = optimizer.step(w, g)
        if report:
            report({"round": k, "gradient_norm": float(np.linalg.norm(g)), "rate": getattr(optimizer, "rate", None)})
    rows.unpersist()
    return w


def step_decay(every: int, factor: float = 0.1) -> Callable[[int], float]:
    return lambda k: factor ** (k // every)
