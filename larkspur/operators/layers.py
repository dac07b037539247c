"""Small layered models fitted by mini-batches: a step's gradient is summed over the tasks that hold a batch.

Rows are dealt to batches by an MD5 digest of seed and key, and written to the shared folder with a folder
a batch, so that a step reads its own rows only.  Weights are a few arrays on the driver, sent with each
step; a task returns one sum of gradients, and a row a weight and task is shuffled.
"""

from __future__ import annotations

import hashlib
import random
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_folder

#: A layer's function, and its slope in terms of what the function gave.
ACTIVATIONS = {
    "relu": (lambda z: np.maximum(z, 0), lambda a: (a > 0).astype(float)),
    "tanh": (np.tanh, lambda a: 1 - a * a),
    "sigmoid": (lambda z: 0.5 * (1 + np.tanh(z / 2)), lambda a: a * (1 - a)),
    "linear": (lambda z: z, np.ones_like),
}


@dataclass
class Layers:
    """Dense layers one after the other: weights (inputs, outputs), biases, and the function after each."""

    weights: list[np.ndarray]
    biases: list[np.ndarray]
    functions: tuple[str, ...]

    @classmethod
    def drawn(cls, sizes: Sequence[int], functions: Sequence[str], seed: int = 0) -> Layers:
        """Uniform weights within the root of 1 / inputs, as a seeded generator draws them."""
        if len(functions) != len(sizes) - 1 or not set(functions) <= set(ACTIVATIONS):
            raise ValueError("a known function for each layer is needed")
        rng = np.random.default_rng(seed)
        bounds = [1 / np.sqrt(n) for n in sizes[:-1]]
        return cls([rng.uniform(-b, b, (n, m)) for b, n, m in zip(bounds, sizes, sizes[1:])], [rng.uniform(-b, b, m) for b, m in zip(bounds, sizes[1:])], tuple(functions))

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for pair in zip(self.weights, self.biases) for p in pair])

    def filled(self, flat: np.ndarray) -> Layers:
        weights, biases, at = [], [], 0
        for w, b in zip(self.weights, self.biases):
            weights.append(flat[at : at + w.size].reshape(w.shape))
            biases.append(flat[at + w.size : at + w.size + b.size])
            at += w.size + b.size
        return Layers(weights, biases, self.functions)

    def outputs(self, x: np.ndarray) -> list[np.ndarray]:
        """What goes into the first layer, and what comes out of each."""
        out = [x]
        for w, b, f in zip(self.weights, self.biases, self.functions):
            out.append(ACTIVATIONS[f][0](out[-1] @ w + b))
        return out

    def gradient(self, x: np.ndarray, y: np.ndarray, masks: Sequence[np.ndarray | None] | None = None) -> tuple[float, np.ndarray]:
        """Sum of squared errors of all rows, and its gradient by ``flat``; ``masks`` are what each layer's outputs are multiplied with (None: nothing)."""
        masks = masks or [None] * len(self.weights)
        into, out = [x], []
        for w, b, f, m in zip(self.weights, self.biases, self.functions, masks):
            out.append(ACTIVATIONS[f][0](into[-1] @ w + b))
            into.append(out[-1] if m is None else out[-1] * m)
        miss = into[-1] - y
        back, parts = 2 * miss, []
        for w, a, before, f, m in zip(self.weights[::-1], out[::-1], into[-2::-1], self.functions[::-1], masks[::-1]):
            back = (back if m is None else back * m) * ACTIVATIONS[f][1](a)
            parts = [before.T @ back, back.sum(0), *parts]
            back = back @ w.T
        return float((miss * miss).sum()), np.concatenate([p.ravel() for p in parts])


def dropped(rows: np.ndarray, width: int, share: float, seed: int) -> np.ndarray | None:
    """What ``width`` outputs of each row are multiplied with: 0 for a share of them, drawn by a mixed hash of row, place and seed (so the same in any task), and what keeps the mean for the rest."""
    if not share:
        return None
    places = np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        z = (rows.astype(np.int64).view(np.uint64) ^ np.uint64(seed * 0xD1342543DE82EF95 % (1 << 64)))[:, None] + places
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return (((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53 >= share) / (1 - share)


def batch_of(key: Column, batches: int, seed: int) -> Column:
    """Number of the batch of a row."""
    digest = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8)
    return F.pmod(F.conv(digest, 16, 10).cast("long"), F.lit(batches)).cast("int")


def plain_batch_of(key, batches: int, seed: int) -> int:
    return int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:8], 16) % batches


def order_of(batches: int, epoch: int, seed: int) -> list[int]:
    """Batches of an epoch in their seeded order."""
    return random.Random(f"{seed}:{epoch}").sample(range(batches), batches)


def _matrices(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns], 1).astype(float)


def step_gradient(rows: DataFrame, model: Layers, columns: list[str], targets: list[str], drops: Sequence[float] = (), draw: int = 0) -> tuple[int, float, np.ndarray]:
    """Number of rows, mean squared error and its gradient over ``rows``; shares of outputs to drop need a column ``_row`` of long."""

    def sums(batches):
        n, loss, total = 0, 0.0, np.zeros(model.flat().size)
        for batch in batches:
            if batch.num_rows:
                masks = [dropped(batch.column("_row").to_numpy(), b.size, p, draw * len(drops) + k) for k, (b, p) in enumerate(zip(model.biases, drops))]
                part, gradient = model.gradient(_matrices(batch, columns), _matrices(batch, targets), masks)
                n, loss, total = n + batch.num_rows, loss + part, total + gradient
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([[n, loss], total])], pa.list_(pa.float64()))], ["sums"])

    parts = rows.select(*columns, *targets, *(["_row"] if drops else [])).mapInArrow(sums, "sums array<double>").select(F.posexplode("sums").alias("k", "v"))
    found = [r["v"] for r in parts.groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()]
    if not found:
        return 0, 0.0, np.zeros(model.flat().size)
    n = int(found[0])
    return n, found[1] / n, np.array(found[2:]) / n


def fit_layers(
    df: DataFrame, key: str, columns: list[str], targets: list[str], model: Layers, optimizer, *, batches: int = 8, epochs: int = 1, seed: int = 0, drops: Sequence[float] = (), report: Callable[[dict], None] | None = None
) -> Layers:
    """``model`` after ``epochs`` passes over the rows, a step of ``optimizer`` for each of ``batches`` mini-batches.

    Batches are the same in all epochs, their order is drawn anew.  Rows with a null are left out; a
    batch without rows makes no step; ``report`` gets an event a step.  ``drops`` are shares of each
    layer's outputs that a step leaves out, drawn anew for each step by seed and key.
    """
    if drops and (len(drops) != len(model.weights) or not all(0 <= p < 1 for p in drops)):
        raise ValueError("a share from 0 to below 1 for each layer is needed")
    known = df.select(F.col(key).alias("_key"), *[F.col(c).cast("double") for c in (*columns, *targets)]).dropna()
    path = f"{shared_folder(df.sparkSession)}/batches-{uuid.uuid4().hex}"
    known = known.withColumn("_batch", batch_of(F.col("_key"), batches, seed))
    known = known.withColumn("_row", F.xxhash64("_key")) if drops else known
    known.write.partitionBy("_batch").parquet(path)
    rows, w = df.sparkSession.read.schema(known.schema).parquet(path), model.flat()
    for epoch in range(epochs):
        for k, batch in enumerate(order_of(batches, epoch, seed)):
            n, loss, gradient = step_gradient(rows.where(F.col("_batch") == batch), model.filled(w), columns, targets, drops, (seed * epochs + epoch) * batches + k)
            if n:
                w = optimizer.step(w, gradient)
                if report:
                    report({"epoch": epoch, "step": epoch * batches + k, "rows": n, "loss": loss})
    return model.filled(w)


def predictions(df: DataFrame, columns: list[str], model: Layers, name: str = "prediction") -> DataFrame:
    """``df`` with the model's outputs as a vector."""

    @F.pandas_udf("array<double>")
    def run(*parts: pd.Series) -> pd.Series:
        return pd.Series(list(model.outputs(np.stack([p.to_numpy(float) for p in parts], 1))[-1]))

    return df.withColumn(name, run(*[F.col(c).cast("double") for c in columns]))
