import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions import scalar, traced, units
from larkspur.functions.windows import ALIASES, FAMILIES, get_window
from larkspur.operators import graph, image, linalg, signal, stats, training
from larkspur.operators import vectors as V
from larkspur.operators.coordinates import Cells, arange, concat, full, random_integers, random_normal, stack, to_vectors
from larkspur.operators.frame import from_arrow
from larkspur.operators.ranges import running
from larkspur.sources import binary, lazy, parquet, text
from larkspur.streaming.dataset import Dataset, collate_vectors, ranked


def vec(spark, *values):
    return spark.createDataFrame([(list(map(float, v)),) for v in values], "v array<double>")


def one(df, c):
    return df.select(c.alias("x")).first()[0]


def cells(spark, a):
    a = np.asarray(a, float)
    rows = [(*map(int, i), float(v)) for i, v in np.ndenumerate(a)]
    return Cells(spark.createDataFrame(rows, ", ".join([*(f"i{k} long" for k in range(a.ndim)), "v double"])), a.shape)


def array(c):
    out = np.full(c.shape, np.nan)
    for r in c.df.collect():
        out[tuple(int(r[a]) for a in c.axes)] = r["v"]
    return out


def test_vectors(spark):
    df = vec(spark, [3, 1, 2, 1])
    v = F.col("v")
    assert one(df, V.cumsum(v)) == [3, 4, 6, 7] and one(df, V.cumprod(v)) == [3, 3, 6, 6]
    assert one(df, V.argsort(v)) == [1, 3, 2, 0] and one(df, V.arg_extreme(v, False)) == 1
    assert [tuple(t) for t in one(df, V.top_k(v, 2))] == [(3, 0), (2, 2)]
    assert one(df, V.roll(v, 1)) == [1, 3, 1, 2] and one(df, V.roll(v, -1)) == [1, 2, 1, 3]
    assert one(df, V.unfold(v, 3)) == [[3, 1, 2], [1, 2, 1]] and one(df, V.unfold(v, 5)) == []
    assert one(df, V.variance(v, 1)) == pytest.approx(np.var([3, 1, 2, 1], ddof=1))
    assert np.allclose(one(df, V.softmax(v)), np.exp([3, 1, 2, 1]) / np.exp([3, 1, 2, 1]).sum())
    for mode in ("full", "same", "valid"):
        assert one(df, V.convolve(v, F.array(F.lit(1.0), F.lit(2.0)), mode)) == list(np.convolve([3, 1, 2, 1], [1, 2], mode))
    for s in [(None, None, 1), (1, -1, 1), (None, None, -1), (-3, None, 2), (3, 0, -2), (2, 2, 1)]:
        assert one(df, V.slice_(v, *s)) == [3.0, 1.0, 2.0, 1.0][slice(*s)]
    with pytest.raises(Exception, match="differ"):
        one(df, V.binary("add", v, F.array(F.lit(1.0))))


def test_cells(spark):
    a, b = np.arange(6.0).reshape(2, 3), np.arange(12.0).reshape(3, 4)
    x = cells(spark, a)
    assert (array(x.matmul(cells(spark, b))) == a @ b).all()
    assert (array(x.transpose()) == a.T).all() and (array(x.reshape(3, 2)) == a.reshape(3, 2)).all()
    assert (array(x.flip(1)) == a[:, ::-1]).all() and (array(x.roll(1, 1)) == np.roll(a, 1, 1)).all()
    assert (array(x.slice(1, None, None, -2)) == a[:, ::-2]).all() and (array(x.select(0, -1)) == a[-1]).all()
    assert (array(x.take([2, 0, 2], 1)) == a[:, [2, 0, 2]]).all() and (array(x.pad(1, 1, 2, 9)) == np.pad(a, ((0, 0), (1, 2)), constant_values=9)).all()
    assert (array(x.combine("add", cells(spark, [10.0, 20.0, 30.0]))) == a + [10, 20, 30]).all()
    assert (array(x.combine("mul", cells(spark, [[2.0], [3.0]]))) == a * [[2], [3]]).all()
    assert (array(concat([x, x], 0)) == np.concatenate([a, a])).all() and array(stack([x, x], 0)).shape == (2, 2, 3)
    assert (array(x.scan("cumsum", 1)) == a.cumsum(1)).all() and np.allclose(array(x.softmax(1)).sum(1), 1)
    for how in ("sum", "mean", "min", "max", "argmin", "argmax", "std"):
        assert np.allclose(array(x.reduce(how, 1)), getattr(np, how)(a, axis=1)) and np.isclose(array(x.reduce(how))[()], getattr(np, how)(a))
    c = cells(spark, [[3.0, 1.0, 1.0]])
    assert (array(c.sort(1)) == [[1, 1, 3]]).all() and (array(c.sort(1, True)) == [[1, 2, 0]]).all()
    assert [r.i1 for r in c.top_k(2, 1, False).orderBy("rank").collect()] == [1, 2]
    assert (array(full(spark, (2, 2), 7)) == 7).all() and [r.values for r in []] == [] and to_vectors(x).orderBy("i0").first()["values"] == [0, 1, 2]
    assert (array(x.broadcast_to(2, 2, 3)) == np.broadcast_to(a, (2, 2, 3))).all()


def test_traced_slopes(spark):
    df = spark.createDataFrame([(0.3, 0.7)], "x double, y double")
    for text_ in ("sin(x) * y ^ 2", "exp(x) / y", "sigmoid(x * y)", "piecewise(x > 0.5, x, x * x)", "sqrt(x) - log(y)", "gelu(x) + erf(y)", "x ^ y"):
        made = traced.parsed(text_, {"x": F.col("x"), "y": F.col("y")})
        at = lambda x, y: traced.parsed(text_, {"x": F.lit(x), "y": F.lit(y)}).value
        h = 1e-6
        got = df.select(made.slopes[0], made.slopes[1], (at(0.3 + h, 0.7) - at(0.3 - h, 0.7)) / (2 * h), (at(0.3, 0.7 + h) - at(0.3, 0.7 - h)) / (2 * h)).first()
        assert got[0] == pytest.approx(got[2], abs=1e-6) and got[1] == pytest.approx(got[3], abs=1e-6)
    with pytest.raises(ValueError):
        traced.parsed("__import__('os')", {"x": F.col("x")})


def test_units(spark):
    assert one(spark.range(1), units.convert(F.lit(100.0), "degC", "degF")) == pytest.approx(212)
    assert one(spark.range(1), units.convert(F.lit(36.0), "km/h", "m/s")) == pytest.approx(10)
    with pytest.raises(ValueError):
        units.convert(F.lit(1.0), "m", "s")
    df = units.with_unit(units.with_unit(spark.range(1).selectExpr("1D AS a", "50D AS b"), "a", "m"), "b", "cm")
    df = units.add_columns(df, "a", "b", "c")
    assert df.first()["c"] == 1.5 and units.unit_of(df, "c") == "m"


def test_windows():
    parameters = {"chebwin": (60,), "dpss": (2.5,), "gaussian": (3,), "general_cosine": ((0.5, 0.5),), "general_gaussian": (1.5, 3), "general_hamming": (0.6,), "kaiser": (8,), "kaiser_bessel_derived": (8,)}
    for name in FAMILIES:
        w = get_window((name, *parameters.get(name, ())), 16, periodic=False)
        assert len(w) == 16 and np.allclose(w, w[::-1], atol=1e-9), name
    assert np.allclose(get_window("han", 8), np.hanning(9)[:8]) and np.allclose(get_window("hamming", 7, False), np.hamming(7)) and set(ALIASES.values()) <= set(FAMILIES)


def test_signals(spark):
    t = np.arange(400)
    x = np.sin(2 * np.pi * t / 40) + 0.5 * np.sin(2 * np.pi * t / 4)
    df = vec(spark, x)
    sos = signal.butter(4, 0.2)
    w, h = signal.response(sos)
    assert abs(h[0]) == pytest.approx(1) and abs(h[np.searchsorted(w, 0.2 * np.pi)]) == pytest.approx(1 / math.sqrt(2), abs=0.02)
    for kind, cut in (("high", 0.3), ("bandpass", (0.2, 0.4)), ("bandstop", (0.2, 0.4))):
        w, h = signal.response(signal.butter(3, cut, kind))
        pass_at = {"high": -1, "bandpass": int(512 * 0.28), "bandstop": 0}[kind]
        assert abs(h[pass_at]) == pytest.approx(1, abs=0.01)
    smooth = np.array(one(df, signal.sos_filtfilt(sos, F.col("v"))))
    assert np.abs(smooth - np.sin(2 * np.pi * t / 40))[20:-20].max() < 0.02
    assert np.allclose(one(df, signal.inverse(signal.rfft(F.col("v")), True)), x)
    assert one(vec(spark, [0, 1, 0, 2, 2, 0, 3, 0]), signal.find_peaks(F.col("v"), height=1.5)) == [3, 6]
    assert len(one(df, signal.resample_poly(F.col("v"), 3, 2))) == 600
    assert one(vec(spark, [0, 1, 2, 3, 4]), signal.fft_shift(F.col("v"))) == [3, 4, 0, 1, 2]
    rows = spark.createDataFrame([("k", int(i), float(v)) for i, v in enumerate(x)], "k string, t long, x double")
    power = signal.welch(rows, "k", "t", "x", width=80).orderBy(F.desc("power")).first()
    assert power["bin"] == 2
    parts = signal.segments(rows, "k", "t", "x", 80, 40).orderBy("segment").collect()
    assert len(parts) == 9 and np.allclose(parts[3]["x"], x[120:200])
    assert signal.check_overlap("hann", 16, 8)


def test_stats_and_algebra(spark):
    a = np.array([[4.0, 1.0, 0.0], [1.0, 3.0, 1.0], [0.0, 1.0, 2.0]])
    df = spark.createDataFrame([(a.ravel().tolist(), [1.0, 2.0, 3.0])], "m array<double>, b array<double>")
    for name, want in (("det", np.linalg.det(a)), ("inv", np.linalg.inv(a)), ("eig_symmetric", np.linalg.eigvalsh(a)[::-1]), ("cholesky", np.linalg.cholesky(a)), ("rref", np.eye(3)), ("rank", 3)):
        assert np.allclose(one(df, linalg.each_matrix(name, F.col("m"), F.lit(3))), np.ravel(want)), name
    lu = np.array(one(df, linalg.each_matrix("lu", F.col("m"), F.lit(3)))).reshape(3, 3, 3)
    assert np.allclose(lu[0] @ lu[1], lu[2] @ a)
    assert np.allclose(one(df, linalg.each_solution(F.col("m"), F.lit(3), F.col("b"))), np.linalg.solve(a, [1, 2, 3]))
    value, _ = linalg.power_iteration(cells(spark, a), rounds=60, tolerance=1e-8)
    assert value == pytest.approx(np.linalg.eigvalsh(a)[-1], rel=1e-4)
    xy = spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(20)], "x double, y double").withColumn("c", F.lit(1.0))
    assert np.allclose(linalg.least_squares(xy, ["x", "c"], "y"), [2, 1])
    assert stats.summary(xy, "y").first()["median"] == 20.0 and stats.linear_regression(xy, "x", "y").first()["slope"] == pytest.approx(2)
    assert one(spark.range(1), stats.poisson_mass(F.lit(3.0), 2.0)) == pytest.approx(math.exp(-2) * 8 / 6)
    w = training.fit(xy.withColumn("x", F.col("x") / 20), ["x"], "y", training.SGD(0.3, momentum=0.8), rounds=60, schedule=training.step_decay(50, 0.5))
    assert np.allclose(w, [40, 1], atol=1)


def test_graph_and_image(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 0.0), (3, 3, 2.0)], "src int, dst int, weight double")
    adj = {r.src: r.neighbours for r in graph.adjacency(graph.mirrored(e)).collect()}
    assert adj == {1: [2], 2: [1, 3], 3: [2, 3]}
    assert {r.src: r.offset for r in graph.with_offsets(graph.adjacency(graph.mirrored(e))).collect()} == {1: 0, 2: 1, 3: 3}
    px = vec(spark, range(4))
    assert one(px, image.resize(F.col("v"), (2, 2), (1, 1), 1)) == [1.5] and one(px, image.resize(F.col("v"), (2, 2), (4, 4), 1, "nearest"))[:4] == [0, 0, 1, 1]


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,x,flag,name\n1,1.5,true,"a, b"\n2,,False,\n9007199254740993,2,TRUE,"q""q"\n')
    df = text.read_csv(spark, str(tmp_path / "a.csv"))
    assert [t for _, t in df.dtypes] == ["bigint", "double", "boolean", "string"]
    assert [tuple(r) for r in df.collect()] == [(1, 1.5, True, "a, b"), (2, None, False, None), (9007199254740993, 2.0, True, 'q"q')]
    (tmp_path / "b.csv").write_text('a\n"open\n')
    with pytest.raises(ValueError):
        text.read_csv(spark, str(tmp_path / "b.csv"))
    for codec in parquet.CODECS:
        parquet.write_parquet(df, str(tmp_path / codec), codec)
    got = parquet.read_parquet(spark, str(tmp_path / "zstd"), ["id"], {"$or": [{"x": {"$gte": 2}}, {"id": 1}]})
    assert sorted(r.id for r in got.collect()) == [1, 9007199254740993]
    with pytest.raises(KeyError):
        parquet.read_parquet(spark, str(tmp_path / "zstd"), ["nothing"])
    with pytest.raises(ValueError):
        parquet.write_parquet(df, str(tmp_path / "x"), "lzo")
    np.save(tmp_path / "a.npy", np.arange(6, dtype=np.int32).reshape(2, 3))
    row = binary.read_npy(spark, str(tmp_path / "a.npy")).first()
    assert row["shape"] == [2, 3] and row["values"] == [0, 1, 2, 3, 4, 5]
    raw = binary.safetensors_bytes({"w": np.ones((2, 2), np.float32), "b": np.zeros(3)})
    (tmp_path / "m.safetensors").write_bytes(raw)
    rows = {r["name"]: r for r in binary.read_safetensors(spark, str(tmp_path / "m.safetensors")).collect()}
    assert rows["w"]["values"] == [1, 1, 1, 1] and rows["b"]["dtype"] == "F64"
    with pytest.raises(ValueError):
        binary.safetensors_header(raw + b"x")
    assert binary.widened("BF16", b"\x80\x3f").tolist() == [1.0]
    from larkspur.operators.frame import Frame

    (tmp_path / "t.arrow").write_bytes(Frame(df).to_ipc())
    assert binary.read_ipc(spark, str(tmp_path / "t.arrow")).count() == 3
    src = lazy.from_lazy_source(spark, "squares", T.StructType([T.StructField("n", T.LongType()), T.StructField("sq", T.LongType())]), [1, 2], lambda p, wanted: ((i * i,) for i in range(p * 10, p * 10 + 3) if wanted == ["sq"]), ["sq"])
    assert src.columns == ["sq"] and sorted(r.sq for r in src.collect()) == [100, 121, 144, 400, 441, 484]
    with pytest.raises(KeyError):
        lazy.from_lazy_source(spark, "none", T.StructType([T.StructField("n", T.LongType())]), [1], lambda p, wanted: (), ["m"])


def test_dataset(spark):
    d = Dataset(spark.createDataFrame([(int(i) * 3, float(i)) for i in range(25)], "o long, v double").repartition(5), "o")
    assert [r["rank"] for r in ranked(d.df, "o").orderBy("o").collect()] == list(range(25))
    assert [r.v for r in d.drop(5).take(3).to_list()] == [5, 6, 7] and d.take(0).to_list() == []
    chunks = d.chunk(10).orderBy("chunk").collect()
    assert [len(c["items"]) for c in chunks] == [10, 10, 5] and [i.v for i in chunks[1]["items"]] == list(range(10, 20))
    first, again, other = (d.shuffle(s).df.orderBy("o_shuffled").collect() for s in (1, 1, 2))
    assert first == again != other and sorted(r.v for r in first) == list(range(25))
    e = d.epochs(2, reshuffle_seed=5).to_list()
    assert [r.epoch for r in e] == [0] * 25 + [1] * 25 and [r.v for r in e[:25]] != [r.v for r in e[25:]]
    assert d.fold(lambda s, r: s * 0.5 + r.v, 0.0) == pytest.approx(sum(v * 0.5 ** (24 - v) for v in range(25)))
    vectors = Dataset(spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0])], "o long, v array<double>"), "o")
    with pytest.raises(Exception, match="differ"):
        vectors.batch(2, collate_vectors("v")).collect()


def test_shuffled_datasets_can_be_cut(spark):
    d = Dataset(spark.createDataFrame([(f"row {i:02}", i) for i in range(30)], "o string, v int").repartition(4), "o")
    for made in (d.shuffle(3), d.epochs(2, reshuffle_seed=1), d.shuffle(1).shuffle(2), d.shuffle(3, buffer_size=7)):
        whole = [r.v for r in made.to_list()]
        assert [r.v for r in made.drop(4).to_list()] == whole[4:]
        assert [[i.v for i in c["items"]] for c in made.chunk(8).orderBy("chunk").collect()] == [whole[k : k + 8] for k in range(0, len(whole), 8)]
        assert [c["batch"] for c in made.batch(9, lambda items: F.transform(items, lambda x: x["v"])).orderBy("chunk").collect()] == [whole[k : k + 9] for k in range(0, len(whole), 9)]
    near = [r.v for r in d.shuffle(3, buffer_size=7).to_list()]
    assert near != list(range(30)) and all(set(near[k : k + 7]) == set(range(k, min(30, k + 7))) for k in range(0, 30, 7))
    with pytest.raises(ValueError):
        d.shuffle(1, buffer_size=0)


def test_running_sums_of_large_groups(spark):
    rng = np.random.default_rng(1)
    rows = [(k, int(t), int(v)) for k, n in (("hot", 300), (None, 40), ("one", 1)) for t, v in zip(rng.permutation(n), rng.integers(0, 9, n))]
    df = spark.createDataFrame(rows, "k string, t long, v long").repartition(5)
    got = {(r.k, r.t): r.s for r in running(df, "t", "s", keys=["k"], amount="v").collect()}
    assert len(got) == len(rows) and all(got[k, t] == sum(v for a, b, v in rows if a == k and b < t) for k, t, _ in rows)
    assert running(df.limit(0), "t", "s", keys=["k"]).count() == 0
    values = {k: [v for a, _, v in rows if a == k] for k in ("hot", None, "one")}
    found = stats.percentiles(df, "v", {"p": 0.3, "m": 0.5, "top": 1.0}, "k").collect()
    assert len(found) == 3 and all(np.allclose((r.p, r.m, r.top), np.quantile(values[r.k], (0.3, 0.5, 1))) for r in found)
    empty = stats.percentiles(spark.createDataFrame([("a", None)], "k string, v double"), "v", {"m": 0.5}, "k").collect()
    assert [tuple(r) for r in empty] == [("a", None)]


def test_error_functions(spark):
    xs = [-30.0, -3.3, -1.0, -0.4, 0.0, 1e-12, 0.49, 0.5, 0.99, 1.0, 2.2, 5.9, 8.0, 26.0, 40.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", scalar.erf(F.col("x")).alias("a"), scalar.erfc(F.col("x")).alias("b")).collect()
    for r in got:
        assert abs(r.a - math.erf(r.x)) < 1e-13 and abs(r.b - math.erfc(r.x)) <= 1e-11 * abs(math.erfc(r.x)) + 1e-300
    odd = spark.createDataFrame([(float("nan"),), (None,), (math.inf,)], "x double").select(scalar.erf(F.col("x")), scalar.erfc(F.col("x"))).collect()
    assert all(map(math.isnan, odd[0])) and tuple(odd[1]) == (None, None) and tuple(odd[2]) == (1.0, 0.0)


def test_blocked_products(spark):
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=(5, 13)), rng.normal(size=(13, 7))
    assert np.allclose(array(cells(spark, a).matmul(cells(spark, b), block=4)), a @ b)
    sparse = Cells(spark.createDataFrame([(0, 0, 1.0), (0, 9, math.inf), (3, 9, 2.0)], "i0 long, i1 long, v double"), (4, 10))
    other = Cells(spark.createDataFrame([(9, 1, 5.0), (0, 0, math.nan)], "i0 long, i1 long, v double"), (10, 2))
    got = {(r.i0, r.i1): r.v for r in sparse.matmul(other, block=3).df.collect()}
    assert set(got) == {(0, 0), (0, 1), (3, 1)} and math.isnan(got[0, 0]) and got[0, 1] == math.inf and got[3, 1] == 10
    with pytest.raises(ValueError):
        cells(spark, a).combine("mul", Cells(spark.range(1).selectExpr("id AS i0", "1.0D AS v"), (10**9,)).unsqueeze(1).unsqueeze(2))


def test_more_cells(spark):
    x = np.array([[-1.7, 0.0, 300.2], [math.nan, 2.5, -0.4]])
    c = cells(spark, x)
    assert np.allclose(array(c.cast("int8")), [[-1, 0, 44], [0, 2, 0]]) and np.allclose(array(c.cast("uint8")), [[255, 0, 44], [0, 2, 0]])
    assert np.allclose(array(c.logical("and", c.flip(1))), [[1, 0, 1], [1, 1, 1]]) and array(c.logical("not")).sum() == 1
    one_, two = c.split([1, 2], 1)
    assert one_.shape == (2, 1) and np.allclose(array(two), x[:, 1:])
    assert array(arange(spark, 2, -1, -0.5)).tolist() == [2, 1.5, 1, 0.5, 0, -0.5] and arange(spark, 3, 1).shape == (0,)
    n = array(random_normal(spark, (400, 5), 3, 2.0, 0.5))
    assert abs(n.mean() - 2) < 0.05 and abs(n.std() - 0.5) < 0.03
    i = array(random_integers(spark, (400, 5), 3, -2, 3))
    assert set(i.ravel()) == {-2, -1, 0, 1, 2}
    with pytest.raises(ValueError):
        c.split([1, 1], 1)


def test_cells_to_the_driver(spark):
    x = np.arange(12.0).reshape(3, 4)
    c = cells(spark, x)
    assert c.at(1, -1) == 7 and c.where(c, c).slice(0, 0, 2).at(1, 2) == 6 and (c.to_array() == x).all()
    assert c.reduce("sum").item() == 66 and Cells(c.df.where("v > 5"), (3, 4)).at(0, 0) is None
    with pytest.raises(ValueError):
        c.item()
    with pytest.raises(ValueError):
        c.to_array(most=5)
    assert one(vec(spark, range(7)), V.unfold(F.col("v"), 3, 2)) == [[0, 1, 2], [2, 3, 4], [4, 5, 6]]


def test_power_iteration_of_a_function(spark):
    scaled = lambda x: x.withColumn("v", F.col("v") * (F.col("i0") + 1))
    value, vector = linalg.power_iteration(scaled, rounds=60, tolerance=1e-6, size=4)
    assert value == pytest.approx(4, rel=1e-3) and vector.orderBy(F.desc(F.abs("v"))).first()["i0"] == 3


def test_frames_of_arrow_tables(spark):
    import pyarrow as pa

    f = from_arrow(spark, pa.table({"name": ["b", None, "a"], "n": pa.array([3, None, 1], pa.int16())}), "row")
    assert f.columns == ["name", "n", "row"] and [r.name for r in f.slice(1).df.collect()] == [None, "a"]


def test_units_and_formulas_of_two(spark):
    assert units.unit("yd").factor == pytest.approx(0.9144) and units.unit("oz").factor * 16 == pytest.approx(units.unit("lb").factor)
    for text_ in ("kmin", "mft", "kyd", "nothing"):
        with pytest.raises(ValueError):
            units.unit(text_)
    df = spark.createDataFrame([(3.0, -4.0), (2.0, 2.0)], "x double, y double")
    for name, want in {"atan2(x, y)": (math.atan2(3, -4), -4 / 25), "hypot(x, y)": (5, 0.6), "min(x, 2 * y)": (-8, 0), "max(x, y)": (3, 1)}.items():
        t = traced.parsed(name, {"x": F.col("x"), "y": F.col("y")})
        r = df.select(t.value.alias("v"), t.slopes[0].alias("d")).first()
        assert np.allclose(tuple(r), want), name
    with pytest.raises(ValueError):
        traced.parsed("atan2(x)", {"x": F.col("x")})


def test_inverse_needs_full_rank(spark):
    for m, n in (([1.0, 2.0, 2.0, 4.0], 2), ([1.0, 2.0, 3.0, 4.0, 5.0, 7.0], 2)):
        with pytest.raises(Exception, match="full rank"):
            one(spark.createDataFrame([(m,)], "m array<double>"), linalg.each_matrix("inv", F.col("m"), F.lit(n)))


def test_short_time_transforms(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=300)
    df = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(x)], "k string, t int, x double")
    z = signal.stft(df, "k", "t", "x", width=40, overlap=30).orderBy("segment").collect()
    w = get_window("hann", 40)
    assert np.allclose(np.array(z[3]["x"]["re"]) + 1j * np.array(z[3]["x"]["im"]), np.fft.rfft(x[30:70] * w) / w.sum())
    back = {r.i: r.x for r in signal.istft(signal.stft(df, "k", "t", "x", width=40, overlap=30), "k", width=40, overlap=30).collect()}
    assert len(back) >= 290 and all(abs(v - x[i]) < 1e-9 for i, v in back.items())
    p = signal.periodogram(df, "k", "t", "x", size=300, detrend=None).orderBy("bin").collect()
    assert np.allclose(p[7]["power"], 2 * abs(np.fft.rfft(x)[7]) ** 2 / 300)
    phase = one(signal.spectrogram(df, "k", "t", "x", width=40, mode="phase").orderBy("segment"), F.col("values"))
    assert np.abs(np.diff(phase)).max() <= math.pi + 1e-9
    tilted = df.withColumn("x", F.col("x") + F.col("t"))
    a, b = (signal.welch(d, "k", "t", "x", width=50, detrend=h).orderBy("bin").collect() for d, h in ((tilted, lambda v: v - np.polyval(np.polyfit(range(50), v, 1), range(50))), (tilted, "linear")))
    assert np.allclose([r.power for r in a], [r.power for r in b])


def test_layers(spark):
    rng = np.random.default_rng(12)
    q, k, v = rng.normal(size=(3, 4)), rng.normal(size=(5, 4)), rng.normal(size=(5, 2))
    e = np.exp(q @ k.T / 2)
    assert np.allclose(array(training.attention(cells(spark, q), cells(spark, k), cells(spark, v))), e / e.sum(1, keepdims=True) @ v)
    x = rng.normal(size=4)
    df = vec(spark, x)
    turned = one(df, training.rotary(F.col("v"), F.lit(3)))
    angles = 3 * 10_000.0 ** (-np.arange(2) / 2)
    assert np.allclose(turned, np.concatenate([x[:2] * np.cos(angles) - x[2:] * np.sin(angles), x[2:] * np.cos(angles) + x[:2] * np.sin(angles)]))
    assert np.allclose(one(df, training.linear(F.col("v"), np.eye(4)[:2], np.ones(2))), x[:2] + 1)
    assert np.allclose(one(df, training.layer_norm(F.col("v"))), (x - x.mean()) / np.sqrt(x.var() + 1e-5))
    dropped = one(vec(spark, np.ones(2000)), training.dropout(F.col("v"), 0.25, 1, F.lit(7)))
    assert set(np.round(dropped, 6)) == {0.0, 1.333333} and abs(np.mean(np.array(dropped) == 0) - 0.25) < 0.05
    labels = spark.createDataFrame([([1.0, 2.0, 0.5], 1)], "z array<double>, y int")
    assert labels.agg(training.cross_entropy(F.col("z"), F.col("y"))).first()[0] == pytest.approx(np.log(np.exp([1, 2, 0.5]).sum()) - 2)


def test_small_matrices_take_whole_vectors(spark, tmp_path):
    from larkspur.plans.registry import QUERIES

    rng = np.random.default_rng(3)
    vectors = {i: rng.normal(size=64).tolist() for i in range(5)}
    spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r for r in QUERIES["small_matrices"](spark, str(tmp_path)).collect()}
    assert set(got) == set(vectors)
    for i, v in vectors.items():
        m = np.array(v).reshape(8, 8)
        assert np.allclose(got[i].det, np.linalg.det(m)) and np.allclose(got[i].inv, np.linalg.inv(m).ravel())
        assert list(got[i]["rank"]) == [8] and np.allclose(got[i].singular_values, np.linalg.svd(m, compute_uv=False))
