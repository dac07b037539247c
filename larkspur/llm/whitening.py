"""Whitening of embeddings by their principal components, refined to double precision.

Entries become whole numbers, so that sums, and products after a whole number near the mean is taken
away, are exact; one row a pair of dimensions and task is shuffled to make the covariance, whose size
depends on the dimension alone.  Its eigenvectors are found in float32 and corrected by iterations of
matrix multiplications (Ogita and Aishima): with X the vectors so far, R = I - X'X and S = X'VX give
estimates of the eigenvalues and a first-order correction of every vector.  Where eigenvalues lie too
close for that correction, the symmetric problem of the cluster alone is solved, its centre taken
away first, and the vectors turned within it.  Products are summed from error-free slices, so that
small differences keep their digits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries are multiplied by SCALE and moved by SHIFT before they are cut to whole numbers.
SCALE, SHIFT = 64, 1_000_000
WIDE = np.longdouble
ROWS = 4096


# --- eigenvectors ---


def _slices(a: np.ndarray, axis: int, bits: int) -> list[np.ndarray]:
    """``a`` as a sum of four float64 arrays of ``bits`` bits each, relative to the greatest entry along ``axis``."""
    out, rest = [], a.astype(WIDE)
    for _ in range(4):
        top = np.abs(rest).max(axis, keepdims=True).astype(np.float64)
        unit = np.ldexp(1.0, np.frexp(np.where(top > 0, top, 1.0))[1] - bits)
        part = np.rint((rest / unit).astype(WIDE)).astype(np.float64) * unit
        out.append(part)
        rest = rest - part
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix product beyond double precision: float64 products of slices are exact, their sum is taken in extended precision."""
    bits = (53 - int(np.ceil(np.log2(max(2, a.shape[1]))))) // 2 - 1
    left, right = _slices(a, 1, bits), _slices(b, 0, bits)
    out = np.zeros((a.shape[0], b.shape[1]), WIDE)
    for order in range(3, -1, -1):  # the smallest first
        for i in range(order + 1):
            out += left[i] @ right[order - i]
    return out


def clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Places of values, two or more, that a chain of steps of at most ``gap`` ties together."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order]) > gap) + 1
    return [c for c in np.split(order, cuts) if len(c) > 1]


def refined_eigen(v: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, to double precision."""
    d = len(v)
    size = float(np.abs(v).max()) if d else 0.0
    if not size:
        return np.zeros(d), np.eye(d)
    a = v.astype(WIDE) / size
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(WIDE)
    one, before = np.eye(d, dtype=WIDE), np.inf
    for _ in range(rounds):
        ax = product(a, x)
        r, s = (_even(m) for m in (one - product(x.T, x), product(x.T, ax)))
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        gap = 2 * float(np.linalg.norm(off.astype(np.float64), 2) + np.linalg.norm(r.astype(np.float64), 2))
        step = values[None, :] - values[:, None]
        near = np.abs(step) <= max(gap, 1e-18)
        e = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, step))
        x = x + product(x, e)
        for held in clusters(values.astype(np.float64), gap):
            x[:, held] = _turned(a, x[:, held])
        moved = float(np.abs(e).max())
        if moved < 1e-17 or (moved < 1e-14 and moved >= before / 2):
            break
        before = moved
    for _ in range(2):
        x = x + product(x, (one - product(x.T, x)) / 2)
    values = np.diag(product(x.T, product(a, x)))
    order = np.argsort(-values, kind="stable")
    return (values[order] * size).astype(np.float64), x[:, order].astype(np.float64)


def _even(m: np.ndarray) -> np.ndarray:
    return (m + m.T) / 2  # rounding that differs between both halves would be divided by small steps


def _turned(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Vectors of a cluster, orthonormal, turned to the eigenvectors of the cluster's own problem about its centre."""
    one = np.eye(x.shape[1], dtype=WIDE)
    for _ in range(3):
        x = x + product(x, (one - product(x.T, x)) / 2)
    centre = np.diag(product(x.T, product(a, x))).mean()
    small = product(x.T, product(a, x) - centre * x)
    top = float(np.abs(small).max())
    return product(x, np.linalg.eigh((_even(small) / top).astype(np.float64))[1].astype(WIDE)) if top else x


# --- distributed sums ---


def _vectors(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``batch`` whose vector counts (``size`` finite entries), and these vectors as whole numbers less ``SHIFT``."""
    col = batch.column("vector")
    starts = col.offsets.to_numpy()
    lengths = np.diff(starts)
    rows = np.flatnonzero((lengths == size) & np.asarray(col.is_valid()))
    flat = col.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)  # nulls are NaN
    held = flat[starts[rows][:, None] + np.arange(size)] if len(rows) else np.empty((0, size))
    fine = np.isfinite(held).all(1)
    held = np.floor(SCALE * held[fine])
    if held.size and np.abs(held).max() >= 2.0**62:
        raise OverflowError("entries beyond 64 bits")
    return rows[fine], held.astype(np.int64)


def _pieces(batches, size: int):
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            part = batch.slice(a, ROWS)
            yield (part, *_vectors(part, size))


def _whole_products(y: np.ndarray) -> np.ndarray:
    """``y'y`` of whole numbers below 2**31, exact: halves of 16 bits, so that float64 products are exact."""
    high, low = (y >> 16).astype(np.float64), (y & 0xFFFF).astype(np.float64)
    cross = (high.T @ low).astype(np.int64)
    return ((high.T @ high).astype(np.int64) << 32) + ((cross + cross.T) << 16) + (low.T @ low).astype(np.int64)


def _summed(rows: DataFrame, make, kind: str, of: str) -> list:
    """Sums, place by place, of the arrays that tasks return (a number a place comes to the driver)."""
    parts = rows.mapInArrow(make, f"sums array<{kind}>").select(F.posexplode("sums").alias("place", "x"))
    return [r["x"] for r in parts.groupBy("place").agg(F.expr(of).alias("x")).orderBy("place").collect()]


def _array(values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([values])], ["sums"])


class Whitener:
    """Fitted to all vectors of a table: their number, sums, centre, components and explained shares."""

    def __init__(self, vectors: DataFrame, components: int):
        sizes = vectors.agg(F.max(F.size("vector"))).first()[0]
        self.size = size = max(0, sizes or 0)
        self.n, self.values, self.error = 0, np.empty(0), 0.0
        if not size:
            return

        def totals(batches):
            n, sums = 0, np.zeros(size, np.int64)
            for _, _, y in _pieces(batches, size):
                n, sums = n + len(y), sums + y.sum(0)
            yield _array(np.append(sums, n))

        *sums, self.n = _summed(vectors, totals, "long", "sum(x)")
        if not self.n:
            return
        self.sums = np.array(sums, np.int64)
        self.centre = np.rint(self.sums / self.n).astype(np.int64)  # near the mean; the rest is exact
        n, centre = self.n, self.centre
        upper = np.triu_indices(size)

        def products(batches):
            sums = np.zeros(len(upper[0]), np.int64)
            for _, _, y in _pieces(batches, size):
                y = y - centre
                if y.size and max(float(np.square(y.astype(np.float64)).sum(0).max()), float(np.abs(y).max()) ** 2 * 2) >= 2.0**62:
                    raise OverflowError("products beyond 64 bits")
                sums += _whole_products(y)[upper]
            yield _array(sums)

        held = np.zeros((size, size), WIDE)
        held[upper] = [WIDE(int(x)) for x in _summed(vectors, products, "long", "sum(cast(x AS decimal(38, 0)))")]
        held = np.where(np.tri(size, k=-1, dtype=bool), held.T, held)
        rest = (self.sums - n * centre).astype(WIDE) / n  # mean less centre
        cov = held / n - np.outer(rest, rest)
        values, x = refined_eigen(cov)
        trace = float(np.trace(cov))
        real = values > trace * 1e-13  # components of no spread are no components
        self.values, kept = values[real][:components], x[:, real][:, :components]
        self.explained = self.values / trace if trace else self.values
        self.matrix = kept / np.sqrt(self.values)
        self.rest = rest.astype(np.float64)
        k = len(self.values)
        if not k:
            return

        def spread(batches):
            sums = np.zeros(k + k * k)
            for _, _, y in _pieces(batches, size):
                z = self.project(y)
                sums += np.concatenate([z.sum(0), (z.T @ z).ravel()])
            yield _array(sums)

        got = np.array(_summed(vectors, spread, "double", "sum(x)")) / n
        self.error = float(np.abs(got[k:].reshape(k, k) - np.outer(got[:k], got[:k]) - np.eye(k)).max())

    def project(self, y: np.ndarray) -> np.ndarray:
        return ((y - self.centre).astype(np.float64) - self.rest) @ self.matrix

    def deviations(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sum of squares of ``n * x - S`` as parts that count 2**62, 2**31 and 1."""
        q = np.abs(self.n * (y - self.centre) - (self.sums - self.n * self.centre))
        high, low = q >> 31, q & (2**31 - 1)
        square = low * low  # below 2**62: its upper half is carried
        return (high * high).sum(1), (2 * high * low + (square >> 31)).sum(1), (square & (2**31 - 1)).sum(1)


def whiten(table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32) -> DataFrame:
    """Return ``(id_col, component, n, deviation, whitened, explained, identity_error)``, a row per vector and component.

    All vectors are fitted and projected; only sums, a number a pair of dimensions, come to the driver.
    ``deviation`` is a decimal, exact at any number of rows.

    Defined cases: null vectors, vectors that hold a null, NaN or infinite entry, empty vectors and
    vectors of another length than the longest are left out; repeated rows count and come back as often
    as they are there; null ids stay; ties of eigenvalues get any orthonormal vectors of their space;
    components without spread (below 1e-13 of the whole) are left out, so equal vectors alone give no
    rows, and neither does an empty table; other columns are ignored.
    """
    rows = table.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    fitted = Whitener(rows.select("vector"), components)
    kind = rows.schema["id"].dataType.simpleString()
    columns = f"id {kind}, d62 long, d31 long, d0 long, z array<double>"

    def apply(batches):
        for part, kept, y in _pieces(batches, fitted.size):
            z = fitted.project(y)
            lists = pa.ListArray.from_arrays(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1], z.ravel())
            yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(kept)), *map(pa.array, fitted.deviations(y)), lists], ["id", "d62", "d31", "d0", "z"])

    spark = table.sparkSession
    made = rows.mapInArrow(apply, columns) if len(fitted.values) else spark.createDataFrame([], columns)
    explained = F.array(*map(F.lit, fitted.explained.tolist())) if len(fitted.values) else F.array().cast("array<double>")
    exact = F.expr("cast(d62 AS decimal(20, 0)) * 4611686018427387904BD + cast(d31 AS decimal(20, 0)) * 2147483648BD + d0").cast("decimal(38, 0)")
    each = made.select("id", exact.alias("deviation"), F.posexplode("z").alias("at", "whitened"))
    return each.select(
        F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(fitted.error).alias("identity_error")
    )
