"""Linear algebra: tall matrices by trees of triangles, large products as Spark aggregates, small matrices by numpy in their task.

A table of small matrices holds one a row, row-major in ``array<double>`` with its number of rows; each is
solved where it lies.  What is large (the rows of a design matrix, the cells of a matrix) is only summed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import checkpointed
from .coordinates import Cells


def gram(df: DataFrame, columns: list[str], target: str | None = None) -> np.ndarray:
    """Sums of products of all pairs of columns: one aggregate whose size is that of the result, not of the data."""
    names = [*columns, *([target] if target else [])]
    sums = [F.sum(F.col(a).cast("double") * F.col(b).cast("double")).alias(f"s{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    row = df.agg(*sums).first()
    out = np.zeros((len(names), len(names)))
    for i in range(len(names)):
        for j in range(i, len(names)):
            out[i, j] = out[j, i] = row[f"s{i}_{j}"] or 0.0
    return out


def gram_of_vectors(df: DataFrame, vector: str, size: int) -> Cells:
    """X'X of the rows of a column of vectors: a matrix product an Arrow batch, added up in its task, and a row a cell and task shuffled.

    Null vectors are left out; one of another size, or with a null entry, raises.
    """

    def run(batches):
        total = None
        for batch in batches:
            held = batch.column(0).drop_null()
            flat = held.flatten()
            if len(flat) != size * len(held) or flat.null_count or (len(held) and set(held.value_lengths().to_pylist()) != {size}):
                raise ValueError(f"a vector hasn't {size} numbers")
            x = flat.to_numpy(zero_copy_only=False).reshape(-1, size)
            if len(x):
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.divmod(np.arange(size * size), size)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i0", "i1", "v"])

    parts = df.select(F.col(vector).cast("array<double>").alias("x")).mapInArrow(run, "i0 long, i1 long, v double")
    return Cells(parts.groupBy("i0", "i1").agg(F.sum("v").alias("v")), (size, size))


def _stacked(batch: pa.RecordBatch) -> np.ndarray:
    """Rows of a batch as a matrix, those with a null left out; a column of vectors gives as many columns."""
    parts = []
    for col in batch.columns:
        if pa.types.is_list(col.type):
            held = col.to_pylist()
            size = max((len(v) for v in held if v is not None), default=0)
            parts.append(np.array([v if v is not None and len(v) == size else [None] * max(1, size) for v in held], float).reshape(len(col), max(1, size)))
        else:
            parts.append(col.cast(pa.float64()).to_numpy(zero_copy_only=False)[:, None])
    rows = np.concatenate(parts, 1)
    return rows[~np.isnan(rows).any(1)]


def triangle(df: DataFrame, columns: list[str], fan: int = 16) -> np.ndarray:
    """R of the QR decomposition of the tall matrix of these columns (numbers or vectors), its diagonal not negative.

    Each task turns its rows, batch by batch, into a triangle; triangles of ``fan`` tasks are stacked
    and turned into one, level by level.  Condition numbers aren't squared as by normal equations.
    Rows with nulls or NaN are left out; without rows there is no triangle (0 x 0).
    """

    def fold(matrices: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        r = None
        for m in matrices:
            if len(m):
                r = np.linalg.qr(m if r is None else np.concatenate([r, m]), "r")
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([r.shape[1]], pa.int32()), pa.array([r.ravel()], pa.list_(pa.float64()))], ["width", "r"])

    def merge(batches):
        return fold(np.asarray(v, float).reshape(-1, w) for b in batches for w, v in zip(b["width"].to_pylist(), b["r"].to_pylist()))

    parts = checkpointed(df.select(*columns).mapInArrow(lambda batches: fold(map(_stacked, batches)), "width int, r array<double>"))
    n = parts.count()
    while n > 1:
        n = -(-n // fan)
        parts = checkpointed(parts.repartition(n).mapInArrow(merge, "width int, r array<double>"))
    row = parts.first()
    if row is None:
        return np.zeros((0, 0))
    r = np.zeros((row["width"], row["width"]))
    held = np.array(row["r"]).reshape(-1, row["width"])
    r[: len(held)] = held
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]


def tall_qr(df: DataFrame, columns: list[str]) -> tuple[DataFrame, np.ndarray]:
    """``df`` with ``q``, a row of the orthonormal factor, and R; twice over, so that Q keeps its columns orthogonal for any R of full rank.

    Rows with nulls or NaN are left out.
    """
    r, out = None, df
    for _ in range(2):
        now = triangle(out, ["q"] if r is not None else columns)
        if not now.size or np.abs(np.diag(now)).min() <= np.abs(np.diag(now)).max() * 1e-15:
            raise ValueError("the columns are not independent")
        out = _times_inverse(out, ["q"] if r is not None else columns, now)
        r = now if r is None else now @ r
    return out, r


def _times_inverse(df: DataFrame, columns: list[str], r: np.ndarray) -> DataFrame:
    inverse = np.linalg.inv(r)

    @F.pandas_udf("array<double>")
    def solve(*parts: pd.Series) -> pd.Series:
        rows = np.concatenate([np.stack([np.asarray(v, float) for v in p]) if p.dtype == object else p.to_numpy(float)[:, None] for p in parts], 1)
        return pd.Series(list(rows @ inverse))

    whole = df
    for c in columns:
        whole = whole.where(F.col(c).isNotNull() & (F.lit(True) if df.schema[c].dataType.typeName() == "array" else ~F.isnan(F.col(c).cast("double"))))
    return whole.withColumn("q", solve(*columns))


def least_squares(df: DataFrame, columns: list[str], target: str) -> np.ndarray:
    """Coefficients from the triangle of columns and target; the shortest ones where columns depend on each other."""
    r = triangle(df, [*columns, target])
    return np.linalg.lstsq(r[:-1, :-1], r[:-1, -1], rcond=None)[0] if r.size else np.zeros(len(columns))


def singular_values(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Of the tall matrix of these columns, largest first."""
    return np.linalg.svd(triangle(df, columns), compute_uv=False)


def principal_axes(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right vectors (as columns)."""
    _, values, vectors = np.linalg.svd(triangle(df, columns))
    return values, vectors.T


def power_iteration(matrix: Cells | Callable[[DataFrame], DataFrame], rounds: int = 1000, tolerance: float = 1e-10, size: int | None = None) -> tuple[float, DataFrame]:
    """Dominant eigenvalue and vector ``(i0, v)``; each round is a join and a sum, cut by a checkpoint every ten.

    In place of a matrix there may be a function from a vector ``(i0, v)`` to its product, with the
    vectors' ``size``.
    """
    from pyspark import StorageLevel

    if isinstance(matrix, Cells):
        size, spark = matrix.shape[0], matrix.df.sparkSession
        cells = matrix.df.persist(StorageLevel.MEMORY_AND_DISK)
        product = lambda x: cells.join(x.select(F.col("i0").alias("i1"), F.col("v").alias("w")), "i1").groupBy("i0").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    else:
        product, spark = matrix, SparkSession.active()
    x = spark.range(size).select(F.col("id").alias("i0"), (1.0 / (F.col("id") + 1)).alias("v"))
    norm = x.agg(F.sqrt(F.sum(F.col("v") * F.col("v")))).first()[0]
    x, value = x.withColumn("v", F.col("v") / norm), 0.0
    for k in range(rounds):
        y = product(x)
        y = y.checkpoint() if k % 10 == 9 and spark.sparkContext.getCheckpointDir() else y.persist(StorageLevel.MEMORY_AND_DISK)
        norm, new = y.join(x.withColumnRenamed("v", "w"), "i0", "left").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))), F.sum(F.col("v") * F.coalesce("w", F.lit(0.0)))).first()
        if not norm:
            return 0.0, x
        x = y.withColumn("v", F.col("v") / norm)
        if abs(new - value) <= tolerance * max(1.0, abs(new)):
            return new, x
        value = new
    return value, x


def _elimination(a: np.ndarray) -> tuple[np.ndarray, list[int], float]:
    """Reduced row echelon form, pivot columns, and the product of pivots with its sign."""
    a, pivots, scale = a.astype(float).copy(), [], 1.0
    for c in range(a.shape[1]):
        r = len(pivots)
        if r == a.shape[0]:
            break
        p = r + int(np.abs(a[r:, c]).argmax())
        if abs(a[p, c]) < 1e-12:
            continue
        if p != r:
            a[[r, p]] = a[[p, r]]
            scale = -scale
        scale *= a[r, c]
        a[r] /= a[r, c]
        others = np.arange(a.shape[0]) != r
        a[others] -= np.outer(a[others, c], a[r])
        pivots.append(c)
    return a, pivots, scale


def _null_space(a: np.ndarray) -> np.ndarray:
    r, pivots, _ = _elimination(a)
    free = [c for c in range(a.shape[1]) if c not in pivots]
    out = np.zeros((len(free), a.shape[1]))
    for k, c in enumerate(free):
        out[k, c] = 1
        out[k, pivots] = -r[: len(pivots), c]
    return out


def _lower_upper(a: np.ndarray) -> np.ndarray:
    """Lower, upper and permutation matrix of a square one, under each other."""
    n = len(a)
    u, low, p = a.astype(float).copy(), np.eye(n), np.eye(n)
    for k in range(n):
        m = k + int(np.abs(u[k:, k]).argmax())
        if m != k:
            u[[k, m]], p[[k, m]] = u[[m, k]], p[[m, k]]
            low[[k, m], :k] = low[[m, k], :k]
        if u[k, k]:
            low[k + 1 :, k] = u[k + 1 :, k] / u[k, k]
            u[k + 1 :] -= np.outer(low[k + 1 :, k], u[k])
    return np.vstack([low, u, p])


def _inverse(a: np.ndarray) -> np.ndarray:
    if a.shape[0] != a.shape[1] or len(_elimination(a)[1]) < len(a):
        raise ValueError("only a square matrix of full rank has an inverse")
    return np.linalg.inv(a)


#: What can be done with a small matrix; the result is flattened row by row.
SMALL = {
    "det": lambda a: np.linalg.det(a), "inv": _inverse, "rank": lambda a: len(_elimination(a)[1]), "rref": lambda a: _elimination(a)[0], "null_space": _null_space, "lu": _lower_upper,
    "qr": lambda a: np.vstack(np.linalg.qr(a)) if a.shape[0] == a.shape[1] else np.linalg.qr(a)[1], "cholesky": np.linalg.cholesky, "eig_symmetric": lambda a: np.linalg.eigvalsh(a)[::-1],
    "eig_general": lambda a: np.stack([np.real(w := np.linalg.eigvals(a)), np.imag(w)], 1), "singular_values": lambda a: np.linalg.svd(a, compute_uv=False), "pseudo_inverse": np.linalg.pinv,
    "frobenius": lambda a: np.linalg.norm(a), "spectral": lambda a: np.linalg.norm(a, 2), "condition": lambda a: np.linalg.cond(a),
}


def each_matrix(name: str, values: Column, rows: Column) -> Column:
    """``SMALL[name]`` of each matrix of a table (null of null; a shape that doesn't fit raises)."""
    f = SMALL[name]

    @F.pandas_udf("array<double>")
    def make(v: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else np.ravel(f(np.asarray(x, float).reshape(int(k), -1))).astype(float) for x, k in zip(v, n)])

    return make(values, rows)


def each_solution(values: Column, rows: Column, right: Column) -> Column:
    """Solution of each square system; one without a single solution gets the least-norm one."""

    @F.pandas_udf("array<double>")
    def make(v: pd.Series, n: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([np.linalg.lstsq(np.asarray(x, float).reshape(int(k), -1), np.asarray(y, float), rcond=None)[0] for x, k, y in zip(v, n, b)])

    return make(values, rows, right)
