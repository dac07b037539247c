"""Tall matrices by trees of triangles, and axes longer than a task's share, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import linalg
from larkspur.operators.coordinates import Cells, from_vectors
from larkspur.operators.ranges import running


def ill_conditioned(n=400, width=7):
    t = np.linspace(0, 1, n)
    return np.stack([t**k for k in range(width)], 1)  # condition about 1e5; squared, 1e10


def table(spark, a, **more):
    rows = [(i, *map(float, row), *[float(v[i]) for v in more.values()]) for i, row in enumerate(a)]
    return spark.createDataFrame(rows, ", ".join(["id long", *[f"x{k} double" for k in range(a.shape[1])], *[f"{n} double" for n in more]])).repartition(7)


@pytest.mark.parametrize("fan", [2, 16])
def test_triangle_of_an_ill_conditioned_matrix(spark, fan):
    a = ill_conditioned()
    columns = [f"x{k}" for k in range(7)]
    want = np.linalg.qr(a, "r")
    want = want * np.sign(np.diag(want))[:, None]
    got = linalg.triangle(table(spark, a), columns, fan=fan)
    assert np.abs(got - want).max() < 1e-12 * np.abs(want).max() and (np.diag(got) > 0).all()
    s = np.linalg.svd(a, compute_uv=False)
    assert np.abs(linalg.singular_values(table(spark, a), columns) - s).max() < 1e-13 * s[0]
    values, vectors = linalg.principal_axes(table(spark, a), columns)
    assert np.allclose(np.abs(vectors.T @ np.linalg.svd(a)[2].T), np.eye(7), atol=1e-7) and np.allclose(values, s)


def test_least_squares_of_an_ill_conditioned_matrix(spark):
    a = ill_conditioned(width=9)
    w = np.arange(1.0, 10)
    got = linalg.least_squares(table(spark, a, y=a @ w), [f"x{k}" for k in range(9)], "y")
    assert np.abs(got - w).max() < 1e-7  # by normal equations the last digits of 1e12 are gone
    twice = table(spark, np.repeat(a[:, 1:2], 2, 1), y=4 * a[:, 1])
    assert np.allclose(linalg.least_squares(twice, ["x0", "x1"], "y"), [2, 2])


def test_orthonormal_factor(spark):
    a = ill_conditioned()
    columns = [f"x{k}" for k in range(7)]
    made, r = linalg.tall_qr(table(spark, a), columns)
    q = np.array([row["q"] for row in made.orderBy("id").collect()])
    assert np.abs(q.T @ q - np.eye(7)).max() < 1e-13 and np.abs(q @ r - a).max() < 1e-13
    with pytest.raises(ValueError):
        linalg.tall_qr(table(spark, np.ones((10, 2))), ["x0", "x1"])


def test_triangles_of_odd_tables(spark):
    few = spark.createDataFrame([(1.0, [2.0, 3.0]), (None, [1.0, 1.0]), (4.0, None), (5.0, [float("nan"), 1.0])], "a double, v array<double>")
    assert np.allclose(linalg.triangle(few, ["a", "v"])[0], [1, 2, 3]) and linalg.triangle(few, ["a", "v"]).shape == (3, 3)
    assert linalg.triangle(few.limit(0), ["a", "v"]).size == 0 and (linalg.least_squares(few.limit(0), ["a"], "a") == 0).all()


@pytest.mark.parametrize("axis", [0, 1, -1])
def test_long_axes(spark, axis):
    m = np.random.default_rng(axis + 5).integers(-3, 4, (7, 30)).astype(float)
    cells = from_vectors(spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(m)], "i long, v array<double>").repartition(3), "i", "v", m.shape)
    kw = {"line": 4}
    assert np.allclose(cells.scan("cumsum", axis, **kw).to_array(), m.cumsum(axis))
    assert np.allclose(cells.scan("cumprod", axis, **kw).to_array(), m.cumprod(axis))
    assert np.array_equal(cells.sort(axis, **kw).to_array(), np.sort(m, axis))
    assert np.array_equal(cells.sort(axis, indices=True, **kw).to_array(), np.argsort(m, axis, kind="stable"))
    e = np.exp(m - m.max(axis, keepdims=True))
    assert np.allclose(cells.softmax(axis, **kw).to_array(), e / e.sum(axis, keepdims=True))
    for largest in (True, False):
        got = {(r["i0"], r["i1"]): r["rank"] for r in cells.top_k(3, axis, largest, **kw).collect()}
        order = np.argsort(-m if largest else m, axis, kind="stable").take(range(3), axis)
        want = {}
        for k in np.ndindex(order.shape):
            place = list(k)
            place[axis], rank = int(order[k]), k[axis] + 1
            want[tuple(place)] = rank
        assert got == want


@pytest.mark.parametrize("how, f", [("product", np.multiply), ("max", np.maximum), ("min", np.minimum), ("sum", np.add)])
def test_results_carried_over_ranges(spark, how, f):
    x = np.random.default_rng(3).uniform(0.5, 1.5, 50)
    df = spark.createDataFrame([(k % 2, k, float(v)) for k, v in enumerate(x)], "g long, t long, x double").repartition(3)
    got = {r["t"]: r["b"] for r in running(df, "t", "b", keys=["g"], amount="x", how=how).collect()}
    for g in (0, 1):
        carried = f.accumulate(x[g::2])
        assert got[g] == {"product": 1, "sum": 0}.get(how)
        assert np.allclose([got[t] for t in range(g + 2, 50, 2)], carried[:-1])


def test_gram_of_vectors(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(90, 5))
    df = spark.createDataFrame([(v.tolist(),) for v in x] + [(None,)], "v array<double>").repartition(7)
    assert np.allclose(linalg.gram_of_vectors(df, "v", 5).to_array(), x.T @ x)
    assert linalg.gram_of_vectors(df.limit(0), "v", 5).df.count() == 0
    for wrong in ([1.0] * 4, [1.0, None, 1.0, 1.0, 1.0]):
        with pytest.raises(Exception, match="a vector hasn't 5 numbers"):
            linalg.gram_of_vectors(df.union(spark.createDataFrame([(wrong,)], df.schema)), "v", 5).df.collect()


@pytest.mark.parametrize("small", [0, 200, 1 << 20])
def test_products_by_blocks_and_by_a_small_side(spark, small):
    """Absent cells have no term; what isn't finite meets only what is there; with 200 cells one side or none is small."""
    rng = np.random.default_rng(2)
    for n, k, m in ((40, 7, 9), (9, 7, 40), (6, 5, 4)):
        a, b = rng.normal(size=(n, k)), rng.normal(size=(k, m))
        a[1, 2], b[3, 1] = np.inf, np.nan
        has_a, has_b = rng.random((n, k)) < 0.5, rng.random((k, m)) < 0.5
        left, right = (Cells(spark.createDataFrame([(int(i), int(j), float(v[i, j])) for i, j in np.argwhere(h)], "i0 long, i1 long, v double").repartition(5), v.shape) for v, h in ((a, has_a), (b, has_b)))
        got = {(r.i0, r.i1): r.v for r in left.matmul(right, block=4, small=small).df.collect()}
        want = {(i, j): sum(a[i, t] * b[t, j] for t in range(k) if has_a[i, t] and has_b[t, j]) for i in range(n) for j in range(m) if (has_a[i] & has_b[:, j]).any()}
        assert got.keys() == want.keys() and all(np.isclose(got[c], v, equal_nan=True) for c, v in want.items())
