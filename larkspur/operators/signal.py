"""Signals: a table of series, one row a sample ``(key, t, x)`` or one a series (``array<double>``).

Spark groups samples into series, cuts them into overlapping segments and averages spectra; a task
transforms a segment with numpy.  Recurrences (filters) need a series in one task: series are many
and each of bounded length, which is the limit of this form.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import get_window
from .ranges import running
from .stats import percentiles


def collected(df: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """One row a series: ``(key, x)`` in order of time."""
    return df.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(time, value))), lambda s: s[value].cast("double")).alias("x"))


def _numbers(f, kind: str = "array<double>"):
    @F.pandas_udf(kind)
    def make(x: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else f(np.asarray(v, float)) for v in x])

    return make


# --- transforms ---

COMPLEX = "struct<re:array<double>,im:array<double>>"


def _parts(z: np.ndarray) -> dict:
    return {"re": np.real(z).ravel(), "im": np.imag(z).ravel()}


def _spectrum(f):
    @F.pandas_udf("re array<double>, im array<double>")
    def make(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_parts(f(np.asarray(v, float))) for v in x], columns=["re", "im"])

    return make


def rfft(x: Column) -> Column:
    """One-sided transform of real vectors as ``struct<re, im>``."""
    return _spectrum(np.fft.rfft)(x)


def fft(x: Column) -> Column:
    return _spectrum(np.fft.fft)(x)


def fft_padded(x: Column) -> Column:
    """With zeros up to the next power of two."""
    return _spectrum(lambda v: np.fft.fft(v, 1 << max(0, len(v) - 1).bit_length()))(x)


def fft2(x: Column, columns: int) -> Column:
    """Two-dimensional transform of row-major matrices."""
    return _spectrum(lambda v: np.fft.fft2(v.reshape(-1, columns)))(x)


def inverse(z: Column, one_sided: bool = False, n: int | None = None) -> Column:
    """Real part of the inverse transform of ``struct<re, im>``."""

    @F.pandas_udf("array<double>")
    def make(p: pd.DataFrame) -> pd.Series:
        z = [np.asarray(a, float) + 1j * np.asarray(b, float) for a, b in zip(p["re"], p["im"])]
        return pd.Series([np.fft.irfft(v, n or 2 * (len(v) - 1)) if one_sided else np.real(np.fft.ifft(v)) for v in z])

    return make(z)


def fft_shift(x: Column, back: bool = False) -> Column:
    """The zero frequency in the middle (or back at the start)."""
    n = F.size(x)
    k = F.floor((n + (0 if back else 1)) / 2).cast("int")
    return F.concat(F.slice(x, k + 1, n), F.slice(x, F.lit(1), k))


# --- filters ---


def butter(order: int, cutoff, kind: str = "low") -> np.ndarray:
    """Second-order sections (b0 b1 b2 a0 a1 a2) of a digital Butterworth filter; cutoffs as shares of half the sampling rate."""
    band = kind in ("bandpass", "bandstop")
    wn = np.atleast_1d(np.asarray(cutoff, float))
    if len(wn) != 1 + band or (wn <= 0).any() or (wn >= 1).any() or order < 1:
        raise ValueError("cutoffs don't fit")
    warped = 4 * np.tan(np.pi * wn / 2)
    poles = -np.exp(1j * np.pi * np.arange(-order + 1, order, 2) / (2 * order))
    zeros, gain = np.empty(0, complex), 1.0
    if kind in ("low", "lowpass"):
        poles, gain = poles * warped[0], warped[0] ** order
    elif kind in ("high", "highpass"):
        gain = np.real(1 / np.prod(-poles))
        poles, zeros = warped[0] / poles, np.zeros(order, complex)
    else:
        width, centre = warped[1] - warped[0], np.sqrt(warped[0] * warped[1])
        if kind == "bandpass":
            half, gain, zeros = poles * width / 2, width**order, np.zeros(order, complex)
        else:
            half, gain = width / 2 / poles, np.real(1 / np.prod(-poles))
            zeros = np.concatenate([np.full(order, 1j * centre), np.full(order, -1j * centre)])
        root = np.sqrt(half**2 - centre**2 + 0j)
        poles = np.concatenate([half + root, half - root])
    gain *= np.real(np.prod(4 - zeros) / np.prod(4 - poles))
    zeros = np.concatenate([(4 + zeros) / (4 - zeros), -np.ones(len(poles) - len(zeros))])
    poles = (4 + poles) / (4 - poles)

    def paired(roots: np.ndarray) -> list[np.ndarray]:
        upper = sorted(roots[roots.imag > 1e-12], key=lambda z: (abs(abs(z) - 1), z.real))
        real = sorted(roots[np.abs(roots.imag) <= 1e-12].real)
        out = [np.real(np.poly([z, z.conjugate()])) for z in upper]
        while real:
            a = real.pop()
            out.append(np.poly([a, real.pop(0)]) if real else np.array([1.0, -a, 0.0]))
        return out

    b, a = paired(zeros), paired(poles)
    sections = np.array([np.concatenate([x, y]) for x, y in zip(b, a)])
    sections[0, :3] *= gain
    return sections


def _filter(sections: np.ndarray, x: np.ndarray, state: np.ndarray | None = None) -> np.ndarray:
    y = x.astype(float)
    for k, (b0, b1, b2, _, a1, a2) in enumerate(sections):
        s1, s2 = (0.0, 0.0) if state is None else state[k]
        out = np.empty_like(y)
        for i, v in enumerate(y.tolist()):
            o = b0 * v + s1
            s1, s2 = b1 * v - a1 * o + s2, b2 * v - a2 * o
            out[i] = o
        y = out
    return y


def _steady(sections: np.ndarray) -> np.ndarray:
    """State of each section after an endless step of height 1."""
    out, scale = [], 1.0
    for b0, b1, b2, _, a1, a2 in sections:
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        s2 = b2 - a2 * gain
        out.append((scale * (b1 - a1 * gain + s2), scale * s2))
        scale *= gain
    return np.array(out)


def _both_ways(sections: np.ndarray, x: np.ndarray, pad: int | None = None) -> np.ndarray:
    taps = 2 * len(sections) + 1 - min((sections[:, 2] == 0).sum(), (sections[:, 5] == 0).sum())
    pad = 3 * taps if pad is None else pad
    if len(x) <= pad:
        raise ValueError(f"more than {pad} samples are needed")
    long = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]) if pad else x
    steady = _steady(sections)
    y = _filter(sections, long, steady * long[0])[::-1]
    y = _filter(sections, y, steady * y[0])[::-1]
    return y[pad : len(y) - pad] if pad else y


def sos_filter(sections: np.ndarray, x: Column) -> Column:
    return _numbers(lambda v: _filter(sections, v))(x)


def sos_filtfilt(sections: np.ndarray, x: Column, pad: int | None = None) -> Column:
    """Forward and backward, without delay."""
    return _numbers(lambda v: _both_ways(sections, v, pad))(x)


def response(sections: np.ndarray, points: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies (radians a sample) and complex response of a filter."""
    w = np.pi * np.arange(points) / points
    z = np.exp(-1j * w)
    return w, np.prod([(s[0] + s[1] * z + s[2] * z**2) / (s[3] + s[4] * z + s[5] * z**2) for s in sections], 0)


def resample_poly(x: Column, up: int, down: int) -> Column:
    """Resampling by up / down with a windowed sinc."""
    g = int(np.gcd(up, down))
    u, d = up // g, down // g
    half = 10 * max(u, d)
    k = np.arange(-half, half + 1)
    taps = np.sinc(k / max(u, d)) * np.hamming(2 * half + 1)
    taps *= u / taps.sum()

    def one(v: np.ndarray) -> np.ndarray:
        wide = np.zeros(len(v) * u)
        wide[::u] = v
        return np.convolve(wide, taps)[half : half + len(wide)][::d][: -(-len(v) * u // d)]

    return _numbers(one)(x)


def find_peaks(x: Column, height: float | None = None, distance: int | None = None, prominence: float | None = None) -> Column:
    """Indices of local maxima (the middle of a plateau), filtered by height, then prominence, then distance (higher peaks first)."""

    def one(v: np.ndarray) -> np.ndarray:
        if len(v) < 3:
            return np.empty(0)
        starts = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        ends = np.append(starts[1:], len(v)) - 1
        top = v[starts]
        mid = np.arange(1, len(starts) - 1)
        mid = mid[(top[mid] > top[mid - 1]) & (top[mid] > top[mid + 1])] if len(starts) > 2 else mid[:0]
        peaks = (starts[mid] + ends[mid]) // 2
        if height is not None:
            peaks = peaks[v[peaks] >= height]
        if prominence is not None:
            keep = []
            for p in peaks:
                left, right = np.flatnonzero(v[:p] > v[p]), np.flatnonzero(v[p + 1 :] > v[p])
                low = v[(left[-1] + 1 if len(left) else 0) : p + 1].min()
                high = v[p : (p + 1 + right[0] if len(right) else len(v))].min()
                keep.append(v[p] - max(low, high) >= prominence)
            peaks = peaks[np.array(keep, bool)]
        if distance is not None and len(peaks):
            keep = np.ones(len(peaks), bool)
            for i in np.argsort(v[peaks], kind="stable")[::-1]:
                if keep[i]:
                    near = np.abs(peaks - peaks[i]) < distance
                    near[i] = False
                    keep &= ~near
            peaks = peaks[keep]
        return peaks.astype(float)

    return _numbers(one)(x)


# --- spectra ---


def segments(df: DataFrame, key: str, time: str, value: str, width: int, overlap: int) -> DataFrame:
    """Overlapping stretches ``(key, segment, x)`` of the series, from samples: whole ones only.  A sample goes to each stretch it lies in; no series is gathered whole or numbered in one task.  Times of a series are distinct."""
    step = width - overlap
    if not 0 <= overlap < width:
        raise ValueError("the overlap is below the width")
    samples = df.select(F.col(key).alias("key"), F.col(time).alias("t"), F.col(value).cast("double").alias("x"))
    rows = running(samples, "t", "i", keys=["key"]).select(F.col("key").alias(key), "x", "i")
    last = F.floor(F.col("i") / step)
    first = F.greatest(F.lit(0), F.floor((F.col("i") - width) / step) + 1)
    dealt = rows.withColumn("segment", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    grouped = dealt.groupBy(key, "segment").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("s"))
    return grouped.where(F.size("s") == width).select(key, "segment", F.transform("s", lambda t: t["x"]).alias("x"))


def _detrended(v: np.ndarray, how) -> np.ndarray:
    if how in (None, False):
        return v
    if callable(how):
        return np.asarray(how(v), float)
    if how == "constant":
        return v - v.mean()
    t = np.arange(len(v)) - (len(v) - 1) / 2
    return v - v.mean() - t * (t @ v) / max(t @ t, 1e-300)


def segment_spectra(parts: DataFrame, window="hann", detrend="constant", x: str = "x") -> DataFrame:
    """``parts`` with the one-sided spectrum of each windowed stretch in place of it."""

    def one(v: np.ndarray) -> np.ndarray:
        return np.fft.rfft(_detrended(v, detrend) * get_window(window, len(v)))

    return parts.withColumn(x, _spectrum(one)(F.col(x)))


def _density(width: int, window, rate: float, scaling: str) -> np.ndarray:
    w = get_window(window, width)
    scale = 1 / (rate * (w * w).sum()) if scaling == "density" else 1 / w.sum() ** 2
    out = np.full(width // 2 + 1, 2 * scale)
    out[0] = scale
    if width % 2 == 0:
        out[-1] = scale
    return out


def welch(
    df: DataFrame, key: str, time: str, value: str, *, width: int = 256, overlap: int | None = None, rate: float = 1.0, window="hann", detrend="constant", scaling: str = "density", average: str = "mean"
) -> DataFrame:
    """``(key, bin, frequency, power)``: mean (or bias-corrected median) power of the stretches, as an aggregate over their bins."""
    if average not in ("mean", "median"):
        raise ValueError(f"no average {average!r}")
    overlap = width // 2 if overlap is None else overlap
    return _mean_power(segments(df, key, time, value, width, overlap), key, width, rate, window, detrend, scaling, average)


def _mean_power(parts: DataFrame, key: str, width: int, rate: float, window, detrend, scaling: str, average: str = "mean") -> DataFrame:
    spectra = segment_spectra(parts, window, detrend)
    scale = F.array(*map(F.lit, _density(width, window, rate, scaling).tolist()))
    power = F.zip_with("x.re", "x.im", lambda a, b: a * a + b * b)
    bins = spectra.select(key, F.posexplode(power).alias("bin", "p"))
    if average == "mean":
        made = bins.groupBy(key, "bin").agg(F.avg("p").alias("p"))
    else:
        made = percentiles(bins, "p", {"m": 0.5}, key, "bin").join(bins.groupBy(key, "bin").agg(F.count("*").alias("n")), [key, "bin"])
        # expected median of n exponential values: 1 + sum of 1 / (2k + 1) - 1 / (2k)
        pairs = F.when(F.col("n") > 2, F.sequence(F.lit(1), F.floor((F.col("n") - 1) / 2).cast("int"))).otherwise(F.array().cast("array<int>"))
        bias = F.aggregate(pairs, F.lit(1.0), lambda s, k: s + 1.0 / (2 * k + 1) - 1.0 / (2 * k))
        made = made.select(key, "bin", (F.col("m") / bias).alias("p"))
    return made.select(key, "bin", (F.col("bin") * (rate / width)).alias("frequency"), (F.col("p") * F.get(scale, F.col("bin"))).alias("power"))


def periodogram(df: DataFrame, key: str, time: str, value: str, *, size: int, rate: float = 1.0, window="boxcar", detrend="constant", scaling: str = "density") -> DataFrame:
    """``welch`` of the first ``size`` samples of each series, in one stretch; shorter series don't count.  ``spectrum.periodogram`` takes a whole series of any length."""
    parts = segments(df, key, time, value, size, 0).where("segment = 0")
    return _mean_power(parts, key, size, rate, window, detrend, scaling)


def spectrogram(df: DataFrame, key: str, time: str, value: str, *, width: int = 256, overlap: int | None = None, rate: float = 1.0, window=("tukey", 0.25), mode: str = "psd") -> DataFrame:
    """``(key, segment, time_s, values)``: power, magnitude, angle, unwrapped phase or complex values of each stretch."""
    overlap = width // 8 if overlap is None else overlap
    spectra = segment_spectra(segments(df, key, time, value, width, overlap), window, "constant")
    scale = F.array(*map(F.lit, _density(width, window, rate, "density").tolist()))
    height = float(get_window(window, width).sum())
    angle = F.zip_with("x.re", "x.im", lambda a, b: F.atan2(b, a))
    made = {
        "psd": F.transform(F.arrays_zip("x.re", "x.im", scale.alias("s")), lambda t: (t["re"] * t["re"] + t["im"] * t["im"]) * t["s"]),
        "magnitude": F.zip_with("x.re", "x.im", lambda a, b: F.sqrt(a * a + b * b) / height),
        "angle": angle,
        "phase": unwrapped(angle),
        "complex": F.zip_with("x.re", "x.im", lambda a, b: F.struct((a / height).alias("re"), (b / height).alias("im"))),
    }[mode]
    middle = (F.col("segment") * (width - overlap) + width / 2) / rate
    return spectra.select(key, "segment", middle.alias("time_s"), made.alias("values"))


def stft(df: DataFrame, key: str, time: str, value: str, *, width: int = 256, overlap: int | None = None, window="hann") -> DataFrame:
    """``(key, segment, x)``: complex spectra of the windowed stretches, over the window's sum."""
    overlap = width // 2 if overlap is None else overlap
    spectra = segment_spectra(segments(df, key, time, value, width, overlap), window, None)
    height = float(get_window(window, width).sum())
    over = lambda part: F.transform(F.col("x")[part], lambda v: v / height).alias(part)
    return spectra.select(key, "segment", F.struct(over("re"), over("im")).alias("x"))


def istft(spectra: DataFrame, key: str, *, width: int = 256, overlap: int | None = None, window="hann") -> DataFrame:
    """``(key, i, x)``: samples whose ``stft`` the spectra are, by overlap and add; where windows add up to nothing there is no sample."""
    overlap = width // 2 if overlap is None else overlap
    w = get_window(window, width)

    @F.pandas_udf("array<double>")
    def back(z: pd.DataFrame) -> pd.Series:
        return pd.Series([np.fft.irfft((np.asarray(a) + 1j * np.asarray(b)) * w.sum(), width) * w for a, b in zip(z["re"], z["im"])])

    weight = F.array(*map(F.lit, (w * w).tolist()))
    parts = spectra.select(F.col(key).alias("key"), F.col("segment").alias("s"), F.posexplode(back("x")).alias("k", "y"))
    parts = parts.select("key", (F.col("s") * (width - overlap) + F.col("k")).alias("i"), "y", F.get(weight, F.col("k")).alias("w"))
    sums = parts.groupBy("key", "i").agg(F.sum("y").alias("y"), F.sum("w").alias("w")).where("w > 1e-10")
    return sums.select(F.col("key").alias(key), "i", (F.col("y") / F.col("w")).alias("x"))


def coherence(df: DataFrame, key: str, time: str, one: str, two: str, *, width: int = 256, overlap: int | None = None, rate: float = 1.0, window="hann") -> DataFrame:
    """``(key, bin, frequency, cross_re, cross_im, coherence)`` of two columns of a series."""
    overlap = width // 2 if overlap is None else overlap
    a = segment_spectra(segments(df, key, time, one, width, overlap), window)
    b = segment_spectra(segments(df, key, time, two, width, overlap), window).withColumnRenamed("x", "y")
    both = a.join(b, [key, "segment"])
    terms = F.arrays_zip(F.col("x.re").alias("a"), F.col("x.im").alias("b"), F.col("y.re").alias("c"), F.col("y.im").alias("d"))
    bins = both.select(key, F.posexplode(terms).alias("bin", "t")).select(key, "bin", "t.*")
    mean = bins.groupBy(key, "bin").agg(
        F.avg(F.expr("a * c + b * d")).alias("re"), F.avg(F.expr("a * d - b * c")).alias("im"), F.avg(F.expr("a * a + b * b")).alias("xx"), F.avg(F.expr("c * c + d * d")).alias("yy")
    )
    scale = F.get(F.array(*map(F.lit, _density(width, window, rate, "density").tolist())), F.col("bin"))
    return mean.select(key, "bin", (F.col("bin") * (rate / width)).alias("frequency"), (F.col("re") * scale).alias("cross_re"), (F.col("im") * scale).alias("cross_im"), F.expr("(re * re + im * im) / nullif(xx * yy, 0)").alias("coherence"))


def csd(df: DataFrame, key: str, time: str, one: str, two: str, *, width: int = 256, overlap: int | None = None, rate: float = 1.0, window="hann") -> DataFrame:
    """``(key, bin, frequency, cross_re, cross_im)``: mean of the conjugate of one column's spectrum times the other's."""
    return coherence(df, key, time, one, two, width=width, overlap=overlap, rate=rate, window=window).drop("coherence")


def unwrapped(angles: Column) -> Column:
    """Angles of a vector without jumps of more than half a turn."""
    turn = 2 * np.pi
    jump = lambda a, b: F.when(F.abs(b - a) > np.pi, -turn * F.round((b - a) / turn)).otherwise(0.0)
    steps = F.transform(angles, lambda v, i: F.when(i == 0, 0.0).otherwise(jump(F.get(angles, i - 1), v)))
    return F.transform(angles, lambda v, i: v + F.aggregate(F.slice(steps, 1, i + 1), F.lit(0.0), lambda s, x: s + x))


def check_overlap(window, width: int, overlap: int, squared: bool = False, tolerance: float = 1e-10) -> bool:
    """Whether shifted windows add up to a constant (or, squared, never to zero)."""
    w = get_window(window, width)
    step = width - overlap
    sums = np.array([(w[k::step] ** (2 if squared else 1)).sum() for k in range(step)])
    return bool(sums.min() > tolerance) if squared else bool(np.abs(sums - np.median(sums)).max() < tolerance)
