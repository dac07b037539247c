"""Series of any length, one row a sample ``(key, time, value)``: filters, convolution, resampling, unwrapping.

Samples are numbered by ranges of time and dealt to blocks of ``size`` numbers, each with as many
samples of its neighbours as the operation looks at; a block is a row that numpy works on.  What
passes from block to block (states of a recurrence, sums of jumps) is carried by small tables with a
row a block, never by a task that holds the series.

Times of a series are distinct; nulls among values count as NaN; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import checkpointed
from .ranges import running

SIZE = 4096
#: Rows of a group where block summaries are carried on.
FAN = 1024


def numbered(df: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """``(key, t, x, i)``: samples with their number within the series, from 0."""
    rows = df.select(F.col(key).alias("key"), F.col(time).alias("t"), F.col(value).cast("double").alias("x"))
    return running(rows, "t", "i", keys=["key"])


def dealt(rows: DataFrame, size: int, before: int = 0, after: int = 0, i: str = "i", block: str = "block") -> DataFrame:
    """``rows`` with ``block``: each goes to its own block of numbers, and to those that look ``before`` or ``after`` numbers beyond theirs."""
    first, last = (F.floor((F.col(i) + F.lit(k)) / size).cast("long") for k in (-after, before))
    return rows.withColumn(block, F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))


def blocks(rows: DataFrame, size: int, before: int = 0, after: int = 0) -> DataFrame:
    """``(key, block, first, t, x)``: a row a block, with the number of its first sample, times and values in order."""
    s = F.sort_array(F.collect_list(F.struct("i", "t", "x")))
    grouped = dealt(rows, size, before, after).groupBy("key", "block").agg(s.alias("s"))
    return grouped.select("key", "block", F.col("s")[0]["i"].alias("first"), F.transform("s", lambda v: v["t"]).alias("t"), F.transform("s", lambda v: v["x"]).alias("x"))


def _joined(left: DataFrame, right: DataFrame, on: dict[str, str], how: str = "inner") -> DataFrame:
    """Join in which null keys match; the right side's keys go."""
    named = right.select(*[F.col(c).alias(f"_{c}") if c in on.values() else F.col(c) for c in right.columns])
    match = functools.reduce(lambda a, b: a & b, [left[a].eqNullSafe(named[f"_{b}"]) for a, b in on.items()])
    return left.join(named, match, how).drop(*[f"_{b}" for b in on.values()])


# --- recurrences ---


def _steps(section, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filters lanes ``x`` (lanes, samples) side by side from states (lanes, 2)."""
    b0, b1, b2, a1, a2 = section
    y, (s1, s2) = np.empty_like(x), state.T
    for t in range(x.shape[1]):
        v = x[:, t]
        o = b0 * v + s1
        s1, s2 = b1 * v - a1 * o + s2, b2 * v - a2 * o
        y[:, t] = o
    return y, np.stack([s1, s2], 1)


@functools.lru_cache(256)
def _free(section, width: int) -> tuple[np.ndarray, np.ndarray]:
    """What states alone give: ``width`` outputs of each unit state, and the matrix that moves a state ``width`` samples on."""
    y, end = _steps(section, np.zeros((2, width)), np.eye(2))
    return y, end.T


def _section(section, x: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One second-order section over a block: lanes filtered from rest, then what their entry states add."""
    width = max(1, math.isqrt(len(x)))
    lanes = -(-len(x) // width)
    wide = np.zeros(lanes * width)
    wide[: len(x)] = x
    y, ends = _steps(section, wide.reshape(lanes, width), np.zeros((lanes, 2)))
    free, move = _free(section, width)
    entries = np.empty((lanes, 2))
    for k in range(lanes):
        entries[k] = entry
        entry = move @ entry + ends[k]
    y += entries @ free
    _, end = _steps(section, x[None, (lanes - 1) * width :], entries[-1:])
    return y.ravel()[: len(x)], end[0]


def cascade(sections, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All sections, one after the other, from states (two a section); output and states at the end."""
    y, ends = np.asarray(x, float), []
    for k, s in enumerate(sections):
        y, end = _section(s, y, state[2 * k : 2 * k + 2])
        ends.append(end)
    return y, np.concatenate(ends)


def entry_states(ends: DataFrame, move: np.ndarray, start: DataFrame | None = None, fan: int = FAN) -> DataFrame:
    """``(key, i, s)``: the state in which each block begins, where block ``i`` turns a state s into ``move @ s + z``.

    ``ends`` is ``(key, i, z)``, ``start`` may name states ``(key, s)`` of the first blocks (zeros otherwise).
    Groups of ``fan`` blocks are folded to one map each, their own entries are found in the same way, and the
    groups are walked through from there, so that no task sees more than ``fan`` rows at a time.
    """
    kind, size = ends.schema["key"].dataType.simpleString(), len(move)
    last = ends.agg(F.max("i")).first()[0] or 0

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        s, out = np.zeros(size) if pdf["s"].iloc[0] is None else np.asarray(pdf["s"].iloc[0], float), []
        for z in pdf["z"]:
            out.append(s)
            s = move @ s + np.asarray(z, float)
        return pd.DataFrame({"key": pdf["key"], "i": pdf["i"], "s": out})

    if last < fan:
        begun = _joined(ends, start, {"key": "key"}, "left") if start is not None else ends.withColumn("s", F.lit(None).cast("array<double>"))
        return begun.groupBy("key").applyInPandas(walk, f"key {kind}, i long, s array<double>")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        s = np.zeros(size)
        for z in pdf.sort_values("i")["z"]:
            s = move @ s + np.asarray(z, float)
        return pd.DataFrame({"key": pdf["key"].iloc[:1], "i": [int(pdf["i"].min()) // fan], "z": [s]})

    grouped = ends.withColumn("group", F.floor(F.col("i") / fan).cast("long"))
    folded = grouped.groupBy("key", "group").applyInPandas(fold, f"key {kind}, i long, z array<double>")
    above = entry_states(checkpointed(folded), np.linalg.matrix_power(move, fan), start, fan)
    return _joined(grouped, above, {"key": "key", "group": "i"}).groupBy("key", "group").applyInPandas(walk, f"key {kind}, i long, s array<double>")


def _recurred(rows: DataFrame, sections: np.ndarray, size: int, start: DataFrame | None = None, fan: int = FAN) -> DataFrame:
    """Numbered ``rows`` with the filter's output in place of ``x``."""
    table = np.atleast_2d(np.asarray(sections, float))
    parts = [tuple((s[[0, 1, 2, 4, 5]] / s[3]).tolist()) for s in table]
    rest = 2 * len(parts)

    @F.pandas_udf("array<double>")
    def from_rest(x: pd.Series) -> pd.Series:
        return pd.Series([cascade(parts, v, np.zeros(rest))[1] for v in x])

    @F.pandas_udf("array<double>")
    def from_state(x: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([cascade(parts, v, np.asarray(e, float))[0] for v, e in zip(x, s)])

    held = checkpointed(blocks(rows, size))
    move = np.stack([cascade(parts, np.zeros(size), e)[1] for e in np.eye(rest)], 1)
    entries = entry_states(checkpointed(held.select("key", F.col("block").alias("i"), from_rest("x").alias("z"))), move, start, fan)
    both = _joined(held, entries, {"key": "key", "block": "i"})
    each = both.select("key", "first", F.posexplode(F.arrays_zip("t", from_state("x", "s").alias("x"))).alias("at", "v"))
    return each.select("key", (F.col("first") + F.col("at")).alias("i"), "v.t", "v.x")


def sos_filter(df: DataFrame, key: str, time: str, value: str, sections, *, size: int = SIZE, fan: int = FAN) -> DataFrame:
    """``(key, time, value)`` filtered by second-order sections ``b0 b1 b2 a0 a1 a2``, from rest.

    Blocks are filtered from rest; their end states are carried through the (linear) effect that a block
    has on a state; each block is then filtered from the state it begins in.
    """
    made = _recurred(numbered(df, key, time, value), sections, size, fan=fan)
    return made.select(F.col("key").alias(key), F.col("t").alias(time), F.col("x").alias(value))


def steady_state(sections) -> np.ndarray:
    """States of all sections after an endless step of height 1."""
    out, scale = [], 1.0
    for b0, b1, b2, a0, a1, a2 in np.atleast_2d(np.asarray(sections, float)):
        gain = (b0 + b1 + b2) / (a0 + a1 + a2)
        s2 = (b2 - a2 * gain) / a0
        out += [scale * ((b1 - a1 * gain) / a0 + s2), scale * s2]
        scale *= gain
    return np.array(out)


def sos_filtfilt(df: DataFrame, key: str, time: str, value: str, sections, *, pad: int | None = None, size: int = SIZE, fan: int = FAN) -> DataFrame:
    """``sos_filter`` forwards and backwards, without delay; both ends are extended by ``pad`` samples, turned about the end values."""
    table = np.atleast_2d(np.asarray(sections, float))
    if pad is None:
        pad = 3 * (2 * len(table) + 1 - min(int((table[:, 2] == 0).sum()), int((table[:, 5] == 0).sum())))
    rows = checkpointed(numbered(df, key, time, value))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.min_by("x", "i").alias("head"), F.max_by("x", "i").alias("tail"))
    least = sizes.agg(F.min("n")).first()[0]
    if least is not None and least <= pad:
        raise ValueError(f"more than {pad} samples are needed")
    known, i, n = _joined(rows, sizes, {"key": "key"}), F.col("i"), F.col("n")
    gone = F.lit(None).cast(rows.schema["t"].dataType)
    body = known.select("key", (i + pad).alias("i"), "t", "x")
    front = known.where(i.between(1, pad)).select("key", (pad - i).alias("i"), gone.alias("t"), (2 * F.col("head") - F.col("x")).alias("x"))
    back = known.where(i.between(n - 1 - pad, n - 2)).select("key", (pad + n + n - 2 - i).alias("i"), gone.alias("t"), (2 * F.col("tail") - F.col("x")).alias("x"))
    long = body.unionByName(front).unionByName(back) if pad else body
    steady = F.array(*map(F.lit, steady_state(table).tolist()))
    for _ in range(2):
        long = checkpointed(long)
        begun = long.where("i = 0").select("key", F.transform(steady, lambda s: s * F.col("x")).alias("s"))
        there = _recurred(long, table, size, begun, fan)
        long = _joined(there, sizes, {"key": "key"}).select("key", (n + 2 * pad - 1 - i).alias("i"), "t", "x")
    kept = _joined(long, sizes, {"key": "key"}).where(i.between(F.lit(pad), n + pad - 1))
    return kept.select(F.col("key").alias(key), F.col("t").alias(time), F.col("x").alias(value))


# --- sliding sums ---


def _outputs(parts: DataFrame, make) -> DataFrame:
    """``(key, i, x)`` from what ``make(block, first, x)`` returns for each block: the number of its first output, and the outputs."""

    @F.pandas_udf("first long, y array<double>")
    def run(block: pd.Series, first: pd.Series, x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([make(int(b), int(f), np.asarray(v, float)) for b, f, v in zip(block, first, x)], columns=["first", "y"])

    each = parts.select("key", run("block", "first", "x").alias("out")).select("key", "out.first", F.posexplode("out.y").alias("at", "x"))
    return each.select("key", (F.col("first") + F.col("at")).alias("i"), "x")


def convolve(df: DataFrame, key: str, time: str, value: str, kernel, mode: str = "full", *, size: int = SIZE) -> DataFrame:
    """``(key, i, value)``: linear convolution of each series with ``kernel``, by overlap-save blocks that carry the samples a kernel reaches back to.

    ``full`` has n + m - 1 outputs, ``same`` the max(n, m) in its middle, ``valid`` the max(n, m) - min(n, m) + 1
    that see all of the shorter one.  A kernel may be longer than ``size``: blocks grow to its length.
    """
    h = np.asarray(kernel, float)
    if not len(h) or mode not in ("full", "same", "valid"):
        raise ValueError("an empty kernel, or an unknown mode")
    m, size = len(h), max(size, len(h))
    rows = checkpointed(numbered(df, key, time, value))

    def block(b: int, first: int, x: np.ndarray):
        from_, end = b * size, first + len(x)  # a block that isn't full to its end is at the end of its series
        upto = (b + 1) * size if end >= (b + 1) * size else min((b + 1) * size, end + m - 1)
        n = 1 << (len(x) + m - 2).bit_length()
        y = np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(h, n), n)[: len(x) + m - 1] if n > 1 else x * h
        return from_, y[from_ - first : upto - first]

    out = _outputs(blocks(rows, size, before=m - 1), block)
    if mode != "full":
        n = F.col("n")
        start = F.floor((F.least(n, F.lit(m)) - 1) / (1 if mode == "valid" else 2))
        long = F.greatest(n, F.lit(m)) - (F.least(n, F.lit(m)) - 1 if mode == "valid" else 0)
        known = _joined(out, rows.groupBy("key").agg(F.count("*").alias("n")), {"key": "key"})
        out = known.where((F.col("i") >= start) & (F.col("i") < start + long)).select("key", (F.col("i") - start).alias("i"), "x")
    return out.select(F.col("key").alias(key), "i", F.col("x").alias(value))


def correlate(df: DataFrame, key: str, time: str, value: str, kernel, mode: str = "full", *, size: int = SIZE) -> DataFrame:
    """``convolve`` with the kernel turned round."""
    return convolve(df, key, time, value, np.asarray(kernel, float)[::-1], mode, size=size)


def phases(up: int, down: int) -> tuple[int, int, int, np.ndarray]:
    """Reduced rates, half length and taps by phase of the low-pass for resampling by up / down: a sinc of ten zero crossings a side under a Hamming window."""
    g = math.gcd(up, down)
    u, d = up // g, down // g
    half = 10 * max(u, d)
    k = np.arange(-half, half + 1)
    taps = np.sinc(k / max(u, d)) * (0.54 + 0.46 * np.cos(np.pi * k / half))
    taps *= u / taps.sum()
    bank = np.zeros((u, -(-len(taps) // u)))
    for p in range(u):
        mine = taps[p::u]
        bank[p, : len(mine)] = mine
    return u, d, half, bank


def resample(df: DataFrame, key: str, time: str, value: str, up: int, down: int, *, size: int = SIZE) -> DataFrame:
    """``(key, i, value)``: each series at ``up / down`` times its rate, ceil(n * up / down) samples.

    Output m lies at m * down between the samples, where one phase of the taps meets them: a tap is
    multiplied with a sample or not looked at, no zeros are put between samples.
    """
    if up < 1 or down < 1:
        raise ValueError("rates are at least 1")
    u, d, half, bank = phases(up, down)
    if u == d:
        u, d, half, bank = 1, 1, 0, np.ones((1, 1))
    reach = half // u + 1
    rows = numbered(df, key, time, value)

    def block(b: int, first: int, x: np.ndarray):
        end = first + len(x)
        low, high = -(-b * size * u // d), -(-min((b + 1) * size, end) * u // d)  # outputs at or after the block's first sample and before the next block's
        m = np.arange(low, high)
        if not len(m):
            return low, m.astype(float)
        at, phase = np.divmod(m * d + half, u)
        near = at[:, None] - np.arange(bank.shape[1]) - first
        inside = (near >= 0) & (near < len(x))
        return low, (np.where(inside, x[np.clip(near, 0, len(x) - 1)], 0) * bank[phase]).sum(1)

    out = _outputs(blocks(rows, size, before=reach, after=reach), block)
    return out.select(F.col("key").alias(key), "i", F.col("x").alias(value))


# --- differences ---


def with_previous(rows: DataFrame, keys: list[str], columns: dict[str, str], i: str = "i", size: int = SIZE) -> DataFrame:
    """Rows numbered by ``i`` with columns of the row before: ``columns`` maps new names to old ones; the first row of a series gets nulls.  Windows span one block."""
    block = "_".join(["", *rows.columns])
    w = Window.partitionBy(*keys, block).orderBy(i)
    looked = dealt(rows, size, before=1, i=i, block=block).withColumns({new: F.lag(old).over(w) for new, old in columns.items()})
    return looked.where(F.floor(F.col(i) / size) == F.col(block)).drop(block)


def unwrap(df: DataFrame, key: str, time: str, value: str, *, size: int = SIZE) -> DataFrame:
    """``df`` with angles whose jumps of more than half a turn are taken out: whole turns are summed up over ranges of time."""
    own = "_".join(["", *df.columns])
    rows = running(df, time, f"{own}_i", keys=[key])
    turn = 2 * np.pi
    looked = with_previous(rows, [key], {f"{own}_last": value}, f"{own}_i", size)
    step = F.col(value) - F.col(f"{own}_last")
    jumps = looked.withColumn(f"{own}_turns", F.when(F.abs(step) > np.pi, -F.round(step / turn)).otherwise(0.0))
    summed = running(jumps.drop(f"{own}_i", f"{own}_last"), time, f"{own}_before", keys=[key], amount=f"{own}_turns")
    return summed.withColumn(value, F.col(value) + (F.col(f"{own}_before") + F.col(f"{own}_turns")) * turn).select(*df.columns)


