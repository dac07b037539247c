"""Mini-batch steps against a plain loop over the same batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import layers, training


@pytest.mark.parametrize("functions", [("tanh", "linear"), ("relu", "sigmoid", "linear")])
def test_gradient_against_differences(functions):
    rng = np.random.default_rng(1)
    model = layers.Layers.drawn([3, *[4] * (len(functions) - 1), 2], functions, 5)
    x, y = rng.normal(size=(6, 3)), rng.normal(size=(6, 2))
    loss, gradient = model.gradient(x, y)
    w = model.flat()
    assert loss == pytest.approx(((model.outputs(x)[-1] - y) ** 2).sum())
    for k in range(len(w)):
        step = np.zeros(len(w))
        step[k] = 1e-6
        slope = (model.filled(w + step).gradient(x, y)[0] - model.filled(w - step).gradient(x, y)[0]) / 2e-6
        assert gradient[k] == pytest.approx(slope, rel=1e-4, abs=1e-5)


@pytest.mark.parametrize("make", [lambda: training.SGD(0.05), lambda: training.Adam(0.02)])
def test_mini_batches_against_a_plain_loop(spark, make):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 2))
    y = np.sin(x[:, 0]) + x[:, 1] ** 2
    df = spark.createDataFrame([(k, *map(float, x[k]), float(y[k])) for k in range(120)] + [(500, None, 1.0, 1.0)], "id long, a double, b double, y double").repartition(3)
    start, events = layers.Layers.drawn([2, 5, 1], ["tanh", "linear"], 3), []
    got = layers.fit_layers(df, "id", ["a", "b"], ["y"], start, make(), batches=3, epochs=2, seed=9, report=events.append)
    w, optimizer, losses = start.flat(), make(), []
    where = np.array([layers.plain_batch_of(k, 3, 9) for k in range(120)])
    for epoch in range(2):
        for batch in layers.order_of(3, epoch, 9):
            mine = where == batch
            loss, gradient = start.filled(w).gradient(x[mine], y[mine][:, None])
            losses.append(loss / mine.sum())
            w = optimizer.step(w, gradient / mine.sum())
    assert np.allclose(got.flat(), w, rtol=1e-10) and np.allclose([e["loss"] for e in events], losses) and sum(e["rows"] for e in events) == 240
    made = layers.predictions(df.where("id < 5"), ["a", "b"], got).orderBy("id").collect()
    assert np.allclose([r["prediction"][0] for r in made], got.outputs(x[:5])[-1][:, 0])


def test_no_rows_make_no_step(spark):
    none = spark.createDataFrame([], "id long, a double, y double")
    start = layers.Layers.drawn([1, 1], ["linear"])
    assert (layers.fit_layers(none, "id", ["a"], ["y"], start, training.SGD(0.1), batches=2).flat() == start.flat()).all()
