"""Complex cells, transforms of long lines, sums to a shape, and dropout against numpy."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.functions import units
from larkspur.operators import complex_cells, layers, training
from larkspur.operators.complex_cells import ComplexCells
from larkspur.operators.coordinates import Cells, axis_names
from larkspur.operators.frame import Frame
from larkspur.sources import binary


def held(spark, a):
    rows = [(*map(int, i), float(v.real), float(v.imag)) for i, v in np.ndenumerate(a)]
    return ComplexCells(spark.createDataFrame(rows, ", ".join([*(f"{x} long" for x in axis_names(a.ndim)), "re double", "im double"])), a.shape)


def drawn(*shape, seed=0):
    rng = np.random.default_rng(seed)
    return rng.normal(size=shape) + 1j * rng.normal(size=shape)


def test_arithmetic_broadcasts(spark):
    a, b = drawn(3, 4), drawn(1, 4, seed=1)
    for name, f in {"add": np.add, "sub": np.subtract, "mul": np.multiply, "div": np.divide}.items():
        assert np.allclose(held(spark, a).combine(name, held(spark, b)).to_array(), f(a, b))
        assert np.allclose(held(spark, b).combine(name, held(spark, a)).to_array(), f(b, a))
        assert np.allclose(held(spark, a).combine(name, 2 - 3j).to_array(), f(a, 2 - 3j))
    assert np.allclose(held(spark, drawn(3, 1)).combine("mul", held(spark, b)).to_array(), drawn(3, 1) * b)
    with pytest.raises(ValueError):
        held(spark, a).combine("add", held(spark, drawn(3, 3)))
    big = held(spark, np.array([1e200 + 1e200j])).combine("div", held(spark, np.array([2e200 + 0j])))
    assert np.allclose(big.to_array(), 0.5 + 0.5j)
    assert np.isnan(held(spark, np.array([1 + 1j])).combine("div", held(spark, np.array([0j]))).to_array()).all()


def test_parts_and_functions(spark):
    a = drawn(2, 5)
    z = held(spark, a)
    for name, want in {"re": a.real, "im": a.imag, "abs": abs(a), "arg": np.angle(a), "power": abs(a) ** 2}.items():
        assert np.allclose(z.part(name).to_array(), want)
    for name, want in {"conj": a.conj(), "neg": -a, "exp": np.exp(a), "turn": 1j * a}.items():
        assert np.allclose(z.apply(name).to_array(), want)
    assert np.allclose(z.reduce("sum", 1).to_array(), a.sum(1)) and np.allclose(z.reduce("mean").to_array(), a.mean())
    back = complex_cells.from_parts(z.part("re"), z.part("im"))
    assert np.allclose(back.to_array(), a) and np.allclose(complex_cells.from_parts(z.part("re")).to_array(), a.real)
    some = Cells(z.part("im").df.where("i0 = 0"), (2, 5))
    assert np.allclose(complex_cells.from_parts(z.part("re"), some).to_array()[1], a[1].real)


@pytest.mark.parametrize("shape", [(3, 12), (5, 7), (2, 3, 8)])
def test_transforms_and_shifts(spark, shape):
    a = drawn(*shape)
    z = held(spark, a)
    for axis in range(len(shape)):
        assert np.allclose(z.fft(axis).to_array(), np.fft.fft(a, axis=axis))
        if shape[axis] in (8, 12):
            assert np.allclose(z.fft(axis, most=6, group=4).to_array(), np.fft.fft(a, axis=axis))
            assert np.allclose(z.fft(axis, inverse=True, most=6, group=4).to_array(), np.fft.ifft(a, axis=axis))
    assert np.allclose(z.fft_all().to_array(), np.fft.fftn(a)) and np.allclose(z.fft_all().fft_all(inverse=True).to_array(), a)
    assert np.allclose(z.shift().to_array(), np.fft.fftshift(a)) and np.allclose(z.shift([-1], back=True).to_array(), np.fft.ifftshift(a, axes=[-1]))
    assert np.allclose(z.shift().shift(back=True).to_array(), a)


def test_a_line_without_factors_raises(spark):
    with pytest.raises(ValueError):
        held(spark, drawn(2, 7)).fft(1, most=5, group=4)


def test_sums_to_a_shape(spark):
    a = np.arange(24.0).reshape(2, 3, 4)
    m = held(spark, a + 0j).part("re")
    for shape, want in {(2, 3, 4): a, (1, 3, 1): a.sum((0, 2), keepdims=True), (3, 4): a.sum(0), (1, 4): a.sum(0).sum(0, keepdims=True), (1,): np.array([a.sum()]), (): a.sum()}.items():
        made = m.sum_to_shape(*shape)
        assert made.shape == shape and np.allclose(made.to_array(), want)
    for wrong in ((2, 2, 4), (1, 2, 3, 4)):
        with pytest.raises(ValueError):
            m.sum_to_shape(*wrong)
    assert Cells(m.df.limit(0), (2, 3, 4)).sum_to_shape(1, 1, 1).to_array().sum() == 0


def test_dropout_of_layers(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(60, 3)), rng.normal(size=(60, 1))
    rows = [(k, *map(float, v), float(t[0])) for k, (v, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double, y double").repartition(5)
    hashes = {r.k: r.h for r in df.select("k", F.xxhash64("k").alias("h")).collect()}
    model, drops, batches, epochs, seed = layers.Layers.drawn((3, 8, 1), ("tanh", "linear"), 2), (0.5, 0.0), 3, 2, 9
    fitted = layers.fit_layers(df, "k", ["a", "b", "c"], ["y"], model, training.SGD(0.05), batches=batches, epochs=epochs, seed=seed, drops=drops)
    w, which = model.flat(), np.array([layers.plain_batch_of(k, batches, seed) for k in range(60)])
    for epoch in range(epochs):
        for k, batch in enumerate(layers.order_of(batches, epoch, seed)):
            mine, draw = np.flatnonzero(which == batch), (seed * epochs + epoch) * batches + k
            mask = layers.dropped(np.array([hashes[i] for i in mine]), 8, 0.5, draw * 2)
            now = model.filled(w)
            out = np.tanh(x[mine] @ now.weights[0] + now.biases[0])
            miss = 2 * ((out * mask) @ now.weights[1] + now.biases[1] - y[mine]) / len(mine)
            back = (miss @ now.weights[1].T) * mask * (1 - out * out)
            w = w - 0.05 * np.concatenate([(x[mine].T @ back).ravel(), back.sum(0), ((out * mask).T @ miss).ravel(), miss.sum(0)])
    assert np.allclose(fitted.flat(), w)
    mask = layers.dropped(np.arange(2000), 50, 0.3, 1)
    assert set(np.unique(mask.round(9))) == {0.0, round(1 / 0.7, 9)} and abs((mask == 0).mean() - 0.3) < 0.01 and abs(mask.mean(0) - 1).max() < 0.1
    assert layers.dropped(np.arange(3), 2, 0.0, 1) is None
    for wrong in ((0.5,), (1.0, 0.0)):
        with pytest.raises(ValueError):
            layers.fit_layers(df, "k", ["a"], ["y"], model, training.SGD(0.1), drops=wrong)


def test_sequential_and_dropout_of_vectors(spark):
    df = spark.createDataFrame([(k, [1.0] * 100) for k in range(20)], "k long, v array<double>")
    steps = training.sequential(lambda v: F.transform(v, lambda x: x * 3), lambda v: training.dropout(v, 0.2, 1, F.col("k")))
    got = np.array([r.v for r in df.select("k", steps(F.col("v")).alias("v")).orderBy("k").collect()])
    again = np.array([r.v for r in df.repartition(7).select("k", steps(F.col("v")).alias("v")).orderBy("k").collect()])
    assert (got == again).all() and set(got.ravel().round(9)) == {0.0, 3.75} and abs((got == 0).mean() - 0.2) < 0.03
    assert (training.sequential()(F.col("v")))._jc.toString() == "v"
    with pytest.raises(ValueError):
        training.dropout(F.col("v"), 1.0, 1, F.col("k"))


def test_arrow_streams_keep_nan_and_null(spark):
    rows = [(1, None), (2, math.nan), (3, 4.5), (4, math.inf)]
    df = spark.createDataFrame(rows, "k long, x double").repartition(3)
    made = binary.ipc_rows(df)
    assert sum(r["rows"] for r in made.collect()) == 4
    back = {r.k: r.x for r in binary.from_ipc_rows(made, df.schema).collect()}
    assert back[1] is None and math.isnan(back[2]) and back[3] == 4.5 and back[4] == math.inf
    assert binary.from_ipc_rows(binary.ipc_rows(df.limit(0)), df.schema).count() == 0
    vector = Frame(df, "k").get_series("x").to_vector()
    assert isinstance(vector, pa.ChunkedArray) and vector.null_count == 1 and math.isnan(vector[1].as_py()) and vector[2].as_py() == 4.5
    with pytest.raises(ValueError):
        Frame(df, "k").get_series("x").to_vector(most=3)


def test_powers_of_units(spark):
    row = spark.range(1).select(units.converted(F.lit(3.0), units.unit("km") ** 2, units.unit("m") ** 2).alias("a"), units.convert(F.lit(1.0), "kg*m/s^2", "N").alias("b")).first()
    assert row.a == pytest.approx(3e6) and row.b == pytest.approx(1)
    with pytest.raises(ValueError):
        units.converted(F.lit(1.0), units.unit("m") ** 2, units.unit("m"))
    with pytest.raises(ValueError):
        units.unit("degC") ** 2
