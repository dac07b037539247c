"""Peaks of series of any length: local maxima, their prominence, and a least distance between them.

Equal neighbours are one run; runs are numbered by ranges, so that both neighbours of a run are at hand
however long a plateau is.  The prominence of a peak needs the nearest higher run on both sides and the
least value on the way there.  Within a node of ``FAN`` runs a peak climbs over tables of maxima and minima
of powers of two; what leaves its node goes on among nodes, each with its maximum and minimum, and comes
down into the node that stops it.  Distance is settled block by block, in rounds, until no peak is open.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import checkpointed
from .long_series import SIZE, _joined, dealt, numbered, with_previous
from .ranges import running

FAN = 4096
#: Peaks that look into one node in one group; more are dealt to copies of the node.
LOOKS = 100_000


def runs(df: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """``(key, i, x, r)``: the first sample of every run of equal values, and the number of the run."""
    rows = numbered(df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))), key, time, value)
    changed = with_previous(rows.drop("t"), ["key"], {"last": "x"}).where(F.col("last").isNull() | (F.col("last") != F.col("x")))
    return running(changed.drop("last"), "i", "r", keys=["key"])


def maxima(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """``(key, r, at, height)`` of runs above both neighbours; ``at`` is the middle sample of a plateau."""
    w = Window.partitionBy("key", "block").orderBy("r")
    looked = dealt(rows, size, before=1, after=1, i="r").withColumns({"low": F.lag("x").over(w), "high": F.lead("x").over(w), "end": F.lead("i").over(w)})
    own = looked.where((F.floor(F.col("r") / size) == F.col("block")) & (F.col("x") > F.col("low")) & (F.col("x") > F.col("high")))
    return own.select("key", "r", F.floor((F.col("i") + F.col("end") - 1) / 2).cast("long").alias("at"), F.col("x").alias("height"))


def _look(elements: DataFrame, looks: DataFrame) -> DataFrame:
    """``looks(key, q, node, at, height, low)`` look left from ``at`` among ``elements(key, node, i, hi, lo)`` of their node.

    Returns them with the least value on the way in ``low`` and, in ``target``, the first element above ``height``.
    """
    kind = elements.schema["key"].dataType.simpleString()

    def climb(mine: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("i")
        i = table["i"].to_numpy()
        high, low = [table["hi"].to_numpy()], [table["lo"].to_numpy()]
        while 2 * (1 << (len(high) - 1)) <= len(i):
            step = 1 << (len(high) - 1)
            high.append(np.maximum(high[-1][:-step], high[-1][step:]))
            low.append(np.minimum(low[-1][:-step], low[-1][step:]))
        at, least, limit = np.searchsorted(i, mine["at"].to_numpy()), mine["low"].to_numpy().copy(), mine["height"].to_numpy()
        for k in range(len(high) - 1, -1, -1) if len(i) else ():
            start = np.maximum(at - (1 << k), 0)
            go = (at >= 1 << k) & ((high[k][np.minimum(start, len(high[k]) - 1)] <= limit) | np.isnan(limit))
            least[go] = np.fmin(least[go], low[k][start[go]])
            at = np.where(go, start, at)
        found = pd.array(np.where(at > 0, i[np.maximum(at - 1, 0)] if len(i) else 0, 0), dtype="Int64")
        found[at == 0] = pd.NA
        return pd.DataFrame({"key": mine["key"], "q": mine["q"], "node": mine["node"], "height": mine["height"], "low": least, "target": found})

    counts = looks.groupBy("key", "node").agg(F.floor((F.count("*") - 1) / LOOKS).cast("int").alias("more"))
    spread = _joined(looks, counts, {"key": "key", "node": "node"}).withColumn("part", F.pmod(F.hash("q"), F.col("more") + 1)).drop("more")
    copies = _joined(elements, counts, {"key": "key", "node": "node"}).withColumn("part", F.explode(F.sequence(F.lit(0), "more"))).drop("more")
    copies = copies.select(*[F.col(c).alias(c) for c in copies.columns])  # columns of its own, where both sides come of one table
    both = spread.groupBy("key", "node", "part").cogroup(copies.groupBy("key", "node", "part"))
    return both.applyInPandas(climb, f"key {kind}, q long, node long, height double, low double, target long")


def lowest_before_higher(elements: DataFrame, looks: DataFrame, fan: int = FAN) -> DataFrame:
    """``(key, q, height, low, target)``: for ``looks(key, q, at, height, low)``, the nearest element below place ``at`` that is above ``height`` (null where there is none) and the least value before it."""
    inside = elements.withColumn("node", F.floor(F.col("i") / fan).cast("long"))
    # a look from the start of a node sees nothing there
    seen = checkpointed(_look(inside, looks.withColumn("node", F.floor(F.col("at") / fan).cast("long"))))
    columns = ["key", "q", "height", "low", "target"]
    open_ = seen.where(F.col("target").isNull() & (F.col("node") > 0))
    done = seen.where(F.col("target").isNotNull() | (F.col("node") <= 0)).select(*columns)
    if open_.isEmpty():
        return done
    nodes = checkpointed(inside.groupBy("key", "node").agg(F.max("hi").alias("hi"), F.min("lo").alias("lo")).withColumnRenamed("node", "i"))
    above = checkpointed(lowest_before_higher(nodes, open_.select("key", "q", F.col("node").alias("at"), "height", "low"), fan))
    down = above.where(F.col("target").isNotNull()).withColumn("node", F.col("target")).withColumn("at", (F.col("target") + 1) * fan).drop("target")
    return done.unionByName(above.where(F.col("target").isNull())).unionByName(_look(inside, down).select(*columns))


def with_prominence(peaks: DataFrame, rows: DataFrame, fan: int = FAN) -> DataFrame:
    """``peaks(key, r, at, height)`` with ``prominence``, measured among the runs ``rows(key, r, x)``."""
    last = rows.agg(F.max("r")).first()[0] or 0
    sides = []
    for place in (F.col("r"), F.lit(last) - F.col("r")):  # the right side is the left one of the series turned round
        elements = rows.select("key", place.alias("i"), F.col("x").alias("hi"), F.col("x").alias("lo"))
        looks = peaks.select("key", F.col("r").alias("q"), place.alias("at"), "height", F.col("height").alias("low"))
        sides.append(lowest_before_higher(elements, looks, fan).select("key", "q", F.col("low").alias(f"low{len(sides)}")))
    both = peaks
    for side in sides:
        both = _joined(both, side, {"key": "key", "r": "q"})
    return both.select("key", "r", "at", "height", (F.col("height") - F.greatest("low0", "low1")).alias("prominence"))


def apart(peaks: DataFrame, distance: float, size: int = SIZE) -> DataFrame:
    """``peaks(key, at, height, ...)`` of which no two are nearer than ``distance``: the higher one stays, of equals the earlier.

    Blocks are at least ``distance`` wide and see the peaks of their neighbours that are near their edges.
    A round decides every peak whose higher neighbours are decided; rounds go on until all are.
    """
    size, kind = max(size, int(np.ceil(distance))), peaks.schema["key"].dataType.simpleString()
    narrow = checkpointed(peaks.select("key", F.col("at").alias("i"), "height", F.lit(None).cast("boolean").alias("kept")))

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i").reset_index(drop=True)
        at, height = pdf["i"].to_numpy(), pdf["height"].to_numpy()
        own = (at // size == pdf["block"].to_numpy()).astype(bool)
        kept = np.array([2 if k is None or k != k else int(k) for k in pdf["kept"]])  # 2: not decided yet
        order = np.lexsort((at, -np.where(np.isnan(height), np.inf, height)))
        rank = np.empty(len(at), np.int64)
        rank[order] = np.arange(len(at))
        low, high = np.searchsorted(at, at - distance, "right"), np.searchsorted(at, at + distance, "left")
        for k in order.tolist():
            if kept[k] == 2 and own[k]:
                higher = kept[low[k] : high[k]][rank[low[k] : high[k]] < rank[k]]
                if (higher == 1).any():
                    kept[k] = 0
                elif not (higher == 2).any():
                    kept[k] = 1
        state = pd.array(kept == 1, dtype="boolean")
        state[kept == 2] = pd.NA
        return pd.DataFrame({"key": pdf["key"], "i": at, "height": height, "kept": state})[own]

    edge = int(np.ceil(distance))
    while not narrow.where("kept IS NULL").isEmpty():
        seen = dealt(narrow, size, before=edge, after=edge)
        narrow = checkpointed(seen.groupBy("key", "block").applyInPandas(decide, f"key {kind}, i long, height double, kept boolean"))
    return _joined(peaks, narrow.where("kept").select("key", "i"), {"key": "key", "at": "i"})


def find_peaks(df: DataFrame, key: str, time: str, value: str, *, height: float | None = None, prominence: float | None = None, distance: float | None = None, plateaus: bool = True, fan: int = FAN, size: int = SIZE) -> DataFrame:
    """``(key, at, height, prominence)`` of the peaks of each series, filtered by height, then prominence, then distance; ``at`` counts samples from 0.

    Nulls and NaN are left out before samples are counted; a plateau at either end is no peak.  Without
    ``plateaus`` a peak is one sample above the two beside it: all samples count, NaN is above all numbers,
    and neither a plateau nor a sample beside a null is a peak.
    """
    if distance is not None and distance < 1:
        raise ValueError("a distance is at least 1")
    rows = checkpointed(runs(df, key, time, value) if plateaus else numbered(df, key, time, value).select("key", "i", "x", F.col("i").alias("r")))
    found = maxima(rows, size)
    found = checkpointed(found if height is None else found.where(F.col("height") >= height))
    made = with_prominence(found, rows.where(F.col("x").isNotNull()).select("key", "r", "x"), fan)
    made = made if prominence is None else made.where(F.col("prominence") >= prominence)
    made = made if distance is None else apart(checkpointed(made), distance, size)
    return made.select(F.col("key").alias(key), "at", "height", "prominence")
