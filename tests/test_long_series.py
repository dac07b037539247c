"""Series cut over several tasks against plain loops over whole arrays."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import long_series, peaks, spectrum
from larkspur.operators.signal import butter
from larkspur.plans import registry, series_queries


def table(spark, series):
    rows = [(k, 3 * t + 1, float(v)) for k, x in series.items() for t, v in enumerate(x)]
    return spark.createDataFrame(rows, "k string, t long, x double").withColumn("i", F.lit(1)).repartition(5)


def by_key(df, place, value):
    out = {}
    for r in df.orderBy("k", place).collect():
        out.setdefault(r["k"], []).append(r[value])
    return {k: np.array(v) for k, v in out.items()}


def plain_filter(sections, x, state=None):
    y = np.array(x, float)
    for k, (b0, b1, b2, a0, a1, a2) in enumerate(sections):
        s1, s2 = (0.0, 0.0) if state is None else state[2 * k : 2 * k + 2]
        for t, v in enumerate(y.tolist()):
            o = (b0 * v + s1) / a0
            s1, s2 = b1 * v - a1 * o + s2, b2 * v - a2 * o
            y[t] = o
    return y


@pytest.fixture(scope="module")
def some():
    rng = np.random.default_rng(5)
    return {"a": rng.normal(size=701), "b": np.cumsum(rng.normal(size=330)), "c": rng.integers(0, 4, 97).astype(float), None: rng.normal(size=64)}


def close(got, want, tolerance=1e-9):
    assert got.keys() == want.keys()
    for k in want:
        assert len(got[k]) == len(want[k]) and np.allclose(got[k], want[k], rtol=tolerance, atol=tolerance), k


@pytest.mark.parametrize("size, fan", [(50, 3), (4096, 1024)])
def test_filter_across_blocks(spark, some, size, fan):
    sections = butter(5, 0.2)
    got = long_series.sos_filter(table(spark, some), "k", "t", "x", sections, size=size, fan=fan)
    assert got.columns == ["k", "t", "x"]
    close(by_key(got, "t", "x"), {k: plain_filter(sections, x) for k, x in some.items()})


def test_filter_both_ways(spark, some):
    sections, pad = butter(3, [0.1, 0.4], "bandpass"), 20
    want = {}
    for k, x in some.items():
        long = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
        steady = long_series.steady_state(sections)
        y = plain_filter(sections, long, steady * long[0])[::-1]
        want[k] = plain_filter(sections, y, steady * y[0])[::-1][pad : pad + len(x)]
    close(by_key(long_series.sos_filtfilt(table(spark, some), "k", "t", "x", sections, pad=pad, size=60, fan=3), "t", "x"), want)
    with pytest.raises(ValueError):
        long_series.sos_filtfilt(table(spark, some), "k", "t", "x", sections, pad=64)


@pytest.mark.parametrize("mode", ["full", "same", "valid"])
@pytest.mark.parametrize("taps, size", [(7, 30), (80, 30)])
def test_convolution_across_blocks(spark, some, mode, taps, size):
    h = np.random.default_rng(taps).normal(size=taps)
    df = table(spark, some)
    close(by_key(long_series.convolve(df, "k", "t", "x", h, mode, size=size), "i", "x"), {k: np.convolve(x, h, mode) for k, x in some.items()})
    close(by_key(long_series.correlate(df, "k", "t", "x", h, mode, size=size), "i", "x"), {k: np.convolve(x, h[::-1], mode) for k, x in some.items()})


@pytest.mark.parametrize("up, down", [(3, 2), (2, 3), (1, 5), (7, 1), (4, 4)])
def test_resampling_across_blocks(spark, some, up, down):
    want = {}
    for k, x in some.items():
        rate = max(up, down)
        half = 10 * rate
        taps = np.sinc(np.arange(-half, half + 1) / rate) * np.hamming(2 * half + 1)
        taps *= up / taps.sum()
        wide = np.zeros(len(x) * up)
        wide[::up] = x
        want[k] = x if up == down else np.convolve(wide, taps)[half:][: len(wide)][::down]
        assert len(want[k]) == -(-len(x) * up // down)
    close(by_key(long_series.resample(table(spark, some), "k", "t", "x", up, down, size=40), "i", "x"), want)


def test_unwrap_across_blocks(spark):
    rng = np.random.default_rng(1)
    true = {"a": np.cumsum(rng.uniform(-2, 2, 400)), "b": np.arange(150) * 2.5}
    df = table(spark, {k: np.angle(np.exp(1j * v)) for k, v in true.items()})
    got = long_series.unwrap(df, "k", "t", "x", size=30)
    assert got.columns == df.columns
    close(by_key(got, "t", "x"), {k: np.unwrap(np.angle(np.exp(1j * v))) for k, v in true.items()})


def test_series_of_no_rows(spark):
    none = spark.createDataFrame([], "k string, t long, x double")
    assert long_series.sos_filter(none, "k", "t", "x", butter(2, 0.3)).count() == 0
    assert long_series.sos_filtfilt(none, "k", "t", "x", butter(2, 0.3)).count() == 0
    assert long_series.convolve(none, "k", "t", "x", [1.0, 2.0], "same").count() == 0
    assert long_series.resample(none, "k", "t", "x", 2, 3).count() == 0
    assert peaks.find_peaks(none, "k", "t", "x", distance=3).count() == 0
    assert spectrum.fft(none, "t", "x").count() == 0
    assert spectrum.periodogram(none, "t", "x").count() == 0


# --- peaks ---


def plain_peaks(x, height, prominence, distance):
    found, n, t = [], len(x), 0
    while t < n:
        end = t
        while end + 1 < n and x[end + 1] == x[t]:
            end += 1
        if 0 < t and end < n - 1 and x[t - 1] < x[t] > x[end + 1]:
            found.append((t + end) // 2)
        t = end + 1
    found = [p for p in found if height is None or x[p] >= height]
    deep = {}
    for p in found:
        sides = []
        for way in (x[:p][::-1], x[p + 1 :]):
            low = x[p]
            for v in way:
                if v > x[p]:
                    break
                low = min(low, v)
            sides.append(low)
        deep[p] = x[p] - max(sides)
    found = [p for p in found if prominence is None or deep[p] >= prominence]
    if distance is not None:
        kept = []
        for p in sorted(found, key=lambda p: (-x[p], p)):
            if all(abs(p - q) >= distance for q in kept):
                kept.append(p)
        found = sorted(kept)
    return [(p, x[p], deep[p]) for p in found]


@pytest.mark.parametrize("height, prominence, distance, fan, size", [(None, None, None, 16, 64), (0.0, 0.5, 40, 4096, 100), (None, None, 2.5, 64, 4096)])
def test_peaks_across_seams(spark, some, height, prominence, distance, fan, size):
    ramp = np.repeat(np.arange(150.0), 2)
    ramp[1::2] -= 5  # each peak is higher than all before: chains over many blocks
    series = some | {"ramp": ramp, "fall": ramp[::-1], "flat": np.r_[0, np.ones(90), 0, 2, 2, 0.0], "same": np.ones(30)}
    got = peaks.find_peaks(table(spark, series), "k", "t", "x", height=height, prominence=prominence, distance=distance, fan=fan, size=size)
    assert got.columns == ["k", "at", "height", "prominence"]
    want = sorted((str(k), p, round(h, 9), round(d, 9)) for k, x in series.items() for p, h, d in plain_peaks(x, height, prominence, distance))
    assert sorted((str(k), p, round(h, 9), round(d, 9)) for k, p, h, d in got.collect()) == want


def test_many_looks_into_one_node(spark, monkeypatch):
    monkeypatch.setattr(peaks, "LOOKS", 5)
    x = np.tile([0.0, 1.0], 200)
    x[1] = 9
    got = peaks.find_peaks(table(spark, {"a": x}), "k", "t", "x", fan=4)
    assert sorted(tuple(r)[1:] for r in got.collect()) == plain_peaks(x, None, None, None)


@pytest.mark.parametrize("name, values", [("plateau", [1, 70, 70, 1, 90, 2, 80.0]), ("null", [1, 70, None, 75, 3, 90, 2, None, 1, 85, 4.0]), ("nan", [1, 70, float("nan"), 75, 3, 90, 2, 99, 1.0])])
def test_peaks_of_events_by_its_sql(spark, tmp_path, name, values):
    rows = [(3 * t, "flat" if name == "plateau" else "odd", v and float(v)) for t, v in enumerate(values)]
    rows += [(3 * t + 1, None, float(v)) for t, v in enumerate([1, 95, 1])] + [(3 * t + 2, "wave", 100 * float(np.sin(t) * np.cos(3 * t))) for t in range(300)]
    spark.createDataFrame(rows, "event_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(registry.ORACLE_SQL["peaks_of_events"]).fetchall()
    got = series_queries.peaks_of_events(spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and {"wave"} < {r[0] for r in got}


# --- transforms ---


@pytest.mark.parametrize("n, most", [(1, 8), (60, 10), (97, 1000), (97, 16)])
def test_transform_of_any_length(spark, n, most):
    rng = np.random.default_rng(n)
    z = rng.normal(size=n) + 1j * rng.normal(size=n)
    df = spark.createDataFrame([(i, float(v.real), float(v.imag)) for i, v in enumerate(z)], spectrum.SCHEMA).repartition(3)
    for back, want in ((False, np.fft.fft(z)), (True, np.fft.ifft(z))):
        got = spectrum.transform(df, n, inverse=back, most=most, group=32).orderBy("i").collect()
        assert [r["i"] for r in got] == list(range(n))
        assert np.allclose([r["re"] + 1j * r["im"] for r in got], want, atol=1e-10)


def test_series_there_and_back(spark):
    x = np.random.default_rng(2).normal(size=90)
    df = table(spark, {"a": x})
    half = spectrum.fft(df, "t", "x", one_sided=True, most=10)
    assert half.count() == 46
    back = spectrum.inverse(half, 90, one_sided=True, most=10).orderBy("i").collect()
    assert np.allclose([r["re"] for r in back], x) and max(abs(r["im"]) for r in back) < 1e-12
    padded = spectrum.fft(df, "t", "x", padded=True).orderBy("i").collect()
    assert np.allclose([r["re"] + 1j * r["im"] for r in padded], np.fft.fft(x, 128))


def test_two_dimensions(spark):
    z = np.random.default_rng(3).normal(size=(6, 9))
    cells = spark.createDataFrame([(i, j, float(z[i, j]), 0.0) for i in range(6) for j in range(9)], "i0 long, i1 long, re double, im double")
    there = spectrum.fft2(cells, (6, 9), group=9)
    got = {(r["i0"], r["i1"]): r["re"] + 1j * r["im"] for r in there.collect()}
    assert np.allclose([[got[i, j] for j in range(9)] for i in range(6)], np.fft.fft2(z))
    back = {(r["i0"], r["i1"]): r["re"] for r in spectrum.fft2(there, (6, 9), back=True).collect()}
    assert np.allclose([[back[i, j] for j in range(9)] for i in range(6)], z)


def test_convolution_of_two_tables(spark):
    rng = np.random.default_rng(4)
    x, h = rng.normal(size=75), rng.normal(size=40)
    a, b = (spectrum.series(table(spark, {"a": v}), "t", "x") for v in (x, h))
    got = spectrum.convolved(a, b, most=16).orderBy("i").collect()
    assert np.allclose([r["x"] for r in got], np.convolve(x, h))


@pytest.mark.parametrize("window, detrend", [("boxcar", "constant"), ("hann", "linear"), ("blackman", None)])
def test_periodogram_of_a_whole_series(spark, window, detrend):
    x = np.random.default_rng(6).normal(size=84) + 0.1 * np.arange(84) + 3
    t = np.arange(84)
    y = x - (x.mean() if detrend == "constant" else np.polyval(np.polyfit(t, x, 1), t) if detrend else 0)
    w = sum((-1) ** k * c * np.cos(2 * np.pi * k * t / 84) for k, c in enumerate(spectrum.COSINES[window]))
    want = np.abs(np.fft.rfft(y * w)) ** 2 / (2.0 * (w * w).sum())
    want[1:-1] *= 2
    got = spectrum.periodogram(table(spark, {"a": x}), "t", "x", rate=2.0, window=window, detrend=detrend, most=12).orderBy("bin").collect()
    assert np.allclose([r["power"] for r in got], want) and np.allclose([r["frequency"] for r in got], np.fft.rfftfreq(84, 0.5))


@pytest.mark.parametrize("n", [84, 89])
def test_periodogram_longer_than_two_factors(spark, n):
    x, t = np.random.default_rng(7).normal(size=n) + 0.1 * np.arange(n), np.arange(n)
    w = 0.5 - 0.5 * np.cos(2 * np.pi * t / n)
    want = np.abs(np.fft.rfft((x - np.polyval(np.polyfit(t, x, 1), t)) * w)) ** 2 / (w * w).sum()
    want[1 : (n + 1) // 2] *= 2
    got = spectrum.periodogram(table(spark, {"a": x}), "t", "x", window="hann", detrend="linear", most=7).orderBy("bin").collect()  # above 7 * 7
    assert [r["bin"] for r in got] == list(range(n // 2 + 1)) and np.allclose([r["power"] for r in got], want)
    assert [r["frequency"] for r in got] == [k / n for k in range(n // 2 + 1)]


@pytest.mark.parametrize("n, most", [(210, 8), (128, 4), (67, 5)])
def test_spectrum_longer_than_two_factors(spark, n, most):
    x = np.random.default_rng(n).normal(size=n)
    there = spectrum.fft(table(spark, {"a": x}), "t", "x", most=most)  # n is above most * most
    got = there.orderBy("i").collect()
    assert [r["i"] for r in got] == list(range(n))
    assert np.allclose([r["re"] + 1j * r["im"] for r in got], np.fft.fft(x))
    back = spectrum.inverse(there, n, most=most).orderBy("i").collect()
    assert np.allclose([r["re"] for r in back], x) and max(abs(r["im"]) for r in back) < 1e-12


def test_lines_longer_than_two_factors(spark):
    z = np.random.default_rng(8).normal(size=(3, 60)) + 1j
    rows = spark.createDataFrame([(5 * k, j, float(v.real), float(v.imag)) for k, line in enumerate(z) for j, v in enumerate(line)], "line long, place long, re double, im double")
    got = {r["i"]: r["re"] + 1j * r["im"] for r in spectrum.transform_lines(rows, 60, most=6, group=6).collect()}
    assert np.allclose([[got[5 * 60 * k + j] for j in range(60)] for k in range(3)], np.fft.fft(z)) and len(got) == 180
