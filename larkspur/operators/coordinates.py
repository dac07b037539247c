"""Tensors in coordinate form: a ``DataFrame`` of cells ``(i0, i1, ..., v)``, each cell once.

This is the form for arrays that no task could hold.  Elementwise operators are joins on the axes
that both sides span, reductions are groupings with partial sums, products are a join on the shared
axis and a sum, scans are windows along one axis, or ranges of it that carry their results on.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import prod

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from .ranges import running

#: Cells of a line that one task sorts or scans.
LINE = 1 << 16
#: Cells that an outer combination (no axis in common) may make.
OUTER = 100_000_000


#: Cells of a matrix that is sent to all tasks, and the size of the axis it shares with the other one.
SMALL, SHARED = 1 << 20, 4096


def _dense(index, k, v, shape) -> tuple[np.ndarray, np.ndarray]:
    """Values of cells, and whether there is one (1 or 0)."""
    values, there = np.zeros(shape), np.zeros(shape)
    values[index, k], there[index, k] = v, 1
    return values, there


def _product(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """How many terms each cell of x y' has, and their sum; what isn't finite meets only what is there."""
    (x, has_x), (y, has_y) = one, two
    with np.errstate(invalid="ignore"):
        sums = x @ y.T
        for i in np.flatnonzero(~np.isfinite(x).all(1)):
            sums[i] = np.where((has_x[i] > 0) & (has_y > 0), x[i] * y, 0).sum(1)
        for j in np.flatnonzero(~np.isfinite(y).all(1)):
            sums[:, j] = np.where((has_x > 0) & (has_y[j] > 0), x * y[j], 0).sum(1)
    return has_x @ has_y.T, sums


def axis_names(n: int) -> list[str]:
    return [f"i{k}" for k in range(n)]


@dataclass(frozen=True)
class Cells:
    df: DataFrame
    shape: tuple

    @property
    def axes(self) -> list[str]:
        return axis_names(len(self.shape))

    def _axis(self, axis: int) -> int:
        if not -len(self.shape) <= axis < len(self.shape):
            raise IndexError(f"no axis {axis}")
        return axis % len(self.shape)

    # --- shape ---

    def permute(self, *order: int) -> Cells:
        names = [F.col(f"i{o}").alias(f"i{k}") for k, o in enumerate(order)]
        return Cells(self.df.select(*names, "v"), tuple(self.shape[o] for o in order))

    def transpose(self) -> Cells:
        return self.permute(*reversed(range(len(self.shape))))

    def _flat(self):
        out = F.lit(0).cast("long")
        for k, n in enumerate(self.shape):
            out = out * n + F.col(f"i{k}")
        return out

    def reshape(self, *shape: int) -> Cells:
        if -1 in shape:
            shape = tuple(prod(self.shape) // -prod(shape) if s == -1 else s for s in shape)
        if prod(shape) != prod(self.shape):
            raise ValueError(f"{self.shape} doesn't fit {shape}")
        flat = self.df.select(self._flat().alias("f"), "v")
        cells, inner = [], 1
        for k in reversed(range(len(shape))):
            cells.append((F.floor(F.col("f") / inner) % shape[k]).cast("long").alias(f"i{k}"))
            inner *= shape[k]
        return Cells(flat.select(*reversed(cells), "v"), tuple(shape))

    def flatten(self) -> Cells:
        return self.reshape(prod(self.shape))

    def squeeze(self, axis: int) -> Cells:
        axis = self._axis(axis)
        if self.shape[axis] != 1:
            raise ValueError(f"axis {axis} has size {self.shape[axis]}")
        keep = [k for k in range(len(self.shape)) if k != axis]
        return self.permute(*keep)

    def unsqueeze(self, axis: int) -> Cells:
        shape = [*self.shape[:axis], 1, *self.shape[axis:]]
        names = [F.lit(0).cast("long").alias(f"i{k}") if k == axis else F.col(f"i{k - (k > axis)}").alias(f"i{k}") for k in range(len(shape))]
        return Cells(self.df.select(*names, "v"), tuple(shape))

    def _moved(self, axis: int, index, size: int, keep=None) -> Cells:
        df = self.df if keep is None else self.df.where(keep)
        return Cells(df.withColumn(f"i{axis}", index.cast("long")), (*self.shape[:axis], size, *self.shape[axis + 1 :]))

    def flip(self, axis: int) -> Cells:
        axis = self._axis(axis)
        return self._moved(axis, self.shape[axis] - 1 - F.col(f"i{axis}"), self.shape[axis])

    def roll(self, shift: int, axis: int) -> Cells:
        axis = self._axis(axis)
        return self._moved(axis, F.pmod(F.col(f"i{axis}") + shift, F.lit(self.shape[axis])), self.shape[axis])

    def slice(self, axis: int, start=None, stop=None, step: int = 1) -> Cells:
        axis = self._axis(axis)
        r = range(self.shape[axis])[start:stop:step]
        i = F.col(f"i{axis}")
        if not len(r):
            return self._moved(axis, i, 0, F.lit(False))
        low, high = min(r[0], r[-1]), max(r[0], r[-1])
        return self._moved(axis, (i - r.start) / step, len(r), i.between(low, high) & (F.pmod(i - r.start, F.lit(abs(step))) == 0))

    def select(self, axis: int, index: int) -> Cells:
        axis = self._axis(axis)
        index = range(self.shape[axis])[index]
        return self.slice(axis, index, index + 1).squeeze(axis)

    def take(self, indices: list[int], axis: int) -> Cells:
        """Cells by index along an axis, in the given order and as often as given."""
        axis = self._axis(axis)
        wanted = [range(self.shape[axis])[i] for i in indices]
        spark = self.df.sparkSession
        table = spark.createDataFrame([(i, k) for k, i in enumerate(wanted)], f"i{axis} long, __to long")
        joined = self.df.join(table, f"i{axis}").withColumn(f"i{axis}", F.col("__to")).drop("__to")
        return Cells(joined.select(*self.axes, "v"), (*self.shape[:axis], len(wanted), *self.shape[axis + 1 :]))

    def pad(self, axis: int, before: int, after: int, value: float = 0.0) -> Cells:
        axis = self._axis(axis)
        moved = self._moved(axis, F.col(f"i{axis}") + before, self.shape[axis] + before + after)
        size = moved.shape[axis]
        others = self.df.select(*[a for a in self.axes if a != f"i{axis}"]).distinct()
        border = F.array(*[F.lit(i).cast("long") for i in (*range(before), *range(size - after, size))])
        edge = others.withColumn(f"i{axis}", F.explode(border)).withColumn("v", F.lit(float(value)))
        return Cells(moved.df.select(*self.axes, "v").union(edge.select(*self.axes, "v")), moved.shape)

    def repeat(self, count: int, axis: int) -> Cells:
        """The whole axis ``count`` times in a row."""
        axis = self._axis(axis)
        n = self.shape[axis]
        rows = self.df.withColumn("__r", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
        return Cells(rows.withColumn(f"i{axis}", F.col(f"i{axis}") + F.col("__r") * n).drop("__r"), (*self.shape[:axis], n * count, *self.shape[axis + 1 :]))

    def broadcast_to(self, *shape: int) -> Cells:
        out = self
        while len(out.shape) < len(shape):
            out = out.unsqueeze(0)
        for k, n in enumerate(shape):
            if out.shape[k] != n:
                if out.shape[k] != 1:
                    raise ValueError(f"{self.shape} doesn't fit {shape}")
                out = out.repeat(n, k)
        return out

    # --- cells ---

    def apply(self, name: str) -> Cells:
        f = {**scalar.UNARY, **scalar.MORE_UNARY}[name]
        return Cells(self.df.withColumn("v", f(F.col("v"))), self.shape)

    def combine(self, name: str, other: Cells | float) -> Cells:
        """Elementwise with broadcasting: a join on the axes that both sides span."""
        f = scalar.BINARY[name]
        if not isinstance(other, Cells):
            return Cells(self.df.withColumn("v", f(F.col("v"), F.lit(float(other)))), self.shape)
        a, b = self, other
        while len(a.shape) < len(b.shape):
            a = a.unsqueeze(0)
        while len(b.shape) < len(a.shape):
            b = b.unsqueeze(0)
        shape = []
        for x, y in zip(a.shape, b.shape):
            if x != y and 1 not in (x, y):
                raise ValueError(f"{self.shape} doesn't fit {other.shape}")
            shape.append(max(x, y) if 0 not in (x, y) else 0)
        right = b.df.select(*[F.col(n).alias(f"j{k}") for k, n in enumerate(b.axes)], F.col("v").alias("w"))
        both = [k for k in range(len(shape)) if a.shape[k] == b.shape[k]]
        if not any(b.shape[k] > 1 or a.shape[k] > 1 for k in both) and (prod(a.shape) > 1 and prod(b.shape) > 1):
            both = []
        on = [F.col(f"i{k}") == F.col(f"j{k}") for k in both]
        if not on and prod(shape) > OUTER:
            raise ValueError(f"an outer product of {prod(shape)} cells; the most is {OUTER}")
        joined = a.df.join(right, on) if on else a.df.crossJoin(right)
        index = [(F.col(f"i{k}") if a.shape[k] >= b.shape[k] else F.col(f"j{k}")).alias(f"i{k}") for k in range(len(shape))]
        return Cells(joined.select(*index, f(F.col("v"), F.col("w")).alias("v")), tuple(shape))

    def where(self, condition: Cells, other: Cells) -> Cells:
        """This where the condition isn't 0, else the other; equal shapes."""
        c = condition.df.withColumnRenamed("v", "c")
        o = other.df.withColumnRenamed("v", "o")
        joined = self.df.join(c, self.axes).join(o, self.axes)
        return Cells(joined.select(*self.axes, F.when(F.col("c") != 0, F.col("v")).otherwise(F.col("o")).alias("v")), self.shape)

    def nonzero(self) -> DataFrame:
        return self.df.where("v <> 0").select(*self.axes)

    def mask(self, condition: Cells) -> DataFrame:
        """Cells where the condition isn't 0, with their place among all cells."""
        joined = self.df.join(condition.df.withColumnRenamed("v", "c"), self.axes).where("c <> 0")
        return joined.select(self._flat().alias("place"), "v")

    # --- reductions and scans ---

    def _reductions(self, axis: int | None, ddof: int) -> dict:
        place = self._flat() if axis is None else F.col(f"i{self._axis(axis)}")
        v = F.col("v")
        odd = F.max(F.isnan(v))
        made = {
            "sum": F.coalesce(F.sum(v), F.lit(0.0)), "mean": F.avg(v), "prod": F.coalesce(F.product(v), F.lit(1.0)),
            "min": F.when(odd, F.lit(float("nan"))).otherwise(F.min(v)), "max": F.when(odd, F.lit(float("nan"))).otherwise(F.max(v)),
            "variance": F.var_pop(v) if not ddof else F.var_pop(v) * F.count(v) / (F.count(v) - ddof),
            "any": F.coalesce(F.bool_or(v != 0), F.lit(False)).cast("double"), "all": F.coalesce(F.bool_and(v != 0), F.lit(True)).cast("double"),
            "argmin": F.min(F.struct(v.alias("v"), place.alias("p")))["p"].cast("double"), "argmax": (-F.max(F.struct(v.alias("v"), (-place).alias("p")))["p"]).cast("double"),
        }
        made["std"] = F.sqrt(made["variance"])
        return made

    def reduce(self, how: str, axis: int | None = None, ddof: int = 0) -> Cells:
        """sum, mean, prod, min, max, variance, std, any, all, argmin or argmax, along an axis or over all cells."""
        keep = self._kept(axis)
        return Cells(self.reduce_many({"v": how}, axis, ddof), tuple(self.shape[k] for k in keep))

    def reduce_many(self, hows: dict[str, str], axis: int | None = None, ddof: int = 0) -> DataFrame:
        """The axes that are left, and a column for each reduction, in one pass."""
        made = self._reductions(axis, ddof)
        return self.df.groupBy(*[F.col(f"i{k}").alias(f"i{n}") for n, k in enumerate(self._kept(axis))]).agg(*[made[how].alias(name) for name, how in hows.items()])

    def sum_to_shape(self, *shape: int) -> Cells:
        """Sums over what broadcasting ``shape`` to this shape has repeated: leading axes that it lacks, and axes where it has size 1.  One grouping, whatever the number of axes."""
        extra = len(self.shape) - len(shape)
        if extra < 0 or any(n not in (1, m) for n, m in zip(shape, self.shape[extra:])):
            raise ValueError(f"{self.shape} doesn't come from {shape}")
        if tuple(shape) == self.shape:
            return self
        kept = {f"i{k}": F.col(f"i{k + extra}") for k, (n, m) in enumerate(zip(shape, self.shape[extra:])) if n == m}
        sums = self.df.select(*[c.alias(name) for name, c in kept.items()], "v").groupBy(*kept).agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("v"))
        return Cells(sums.select(*[F.col(a) if a in kept else F.lit(0).cast("long").alias(a) for a in axis_names(len(shape))], "v"), tuple(shape))

    def _kept(self, axis: int | None) -> list[int]:
        return [] if axis is None else [k for k in range(len(self.shape)) if k != self._axis(axis)]

    def _along(self, axis: int) -> Window:
        return Window.partitionBy(*[a for k, a in enumerate(self.axes) if k != axis])

    def _long(self, axis: int, line: int) -> bool:
        return self.shape[axis] > line

    def _others(self, axis: int) -> list[str]:
        return [a for k, a in enumerate(self.axes) if k != axis]

    def scan(self, how: str, axis: int, line: int = LINE) -> Cells:
        """cumsum or cumprod along an axis; lines of more than ``line`` cells are cut into ranges that carry sums or products on."""
        axis = self._axis(axis)
        if self._long(axis, line):
            before = running(self.df, f"i{axis}", "__before", keys=self._others(axis), amount="v", how={"cumsum": "sum", "cumprod": "product"}[how])
            both = F.col("__before") + F.col("v") if how == "cumsum" else F.col("__before") * F.col("v")
            return Cells(before.select(*self.axes, both.alias("v")), self.shape)
        w = self._along(axis).orderBy(f"i{axis}").rowsBetween(Window.unboundedPreceding, 0)
        f = {"cumsum": F.sum, "cumprod": F.product}[how]
        return Cells(self.df.withColumn("v", f("v").over(w)), self.shape)

    def sort(self, axis: int, indices: bool = False, line: int = LINE) -> Cells:
        """Ascending and stable along an axis: values, or where they stood; places in long lines come from counts by range."""
        axis = self._axis(axis)
        if self._long(axis, line):
            ordered = self.df.withColumn("__order", F.struct("v", f"i{axis}"))
            ranked = running(ordered, "__order", "__r", keys=self._others(axis)).drop("__order")
        else:
            ranked = self.df.withColumn("__r", F.row_number().over(self._along(axis).orderBy("v", f"i{axis}")) - 1)
        value = F.col(f"i{axis}").cast("double") if indices else F.col("v")
        cells = [F.col("__r").cast("long").alias(a) if k == axis else F.col(a) for k, a in enumerate(self.axes)]
        return Cells(ranked.select(*cells, value.alias("v")), self.shape)

    def top_k(self, k: int, axis: int, largest: bool = True, line: int = LINE) -> DataFrame:
        """The ``k`` first cells along an axis with their ``rank``; first index first on ties.  Stretches of a long line are cut to their own ``k`` first, then longer stretches of what is left."""
        axis = self._axis(axis)
        if not 0 < k <= self.shape[axis]:
            raise ValueError("k is out of range")
        order = [F.desc("v") if largest else F.asc("v"), f"i{axis}"]
        left, width = self.df, line
        while width < self.shape[axis]:
            stretch = Window.partitionBy(*self._others(axis), F.floor(F.col(f"i{axis}") / width)).orderBy(*order)
            left = left.withColumn("rank", F.row_number().over(stretch)).where(F.col("rank") <= k).drop("rank")
            width *= max(2, line // k)
        return left.withColumn("rank", F.row_number().over(self._along(axis).orderBy(*order))).where(F.col("rank") <= k)

    def softmax(self, axis: int, line: int = LINE) -> Cells:
        """Exponentials over their sum along an axis; long lines meet their maximum and sum, which are partial aggregates, in a join."""
        axis = self._axis(axis)
        if self._long(axis, line):
            keys, df = self._others(axis), self.df
            fit = lambda rows, stats: rows.join(stats, keys) if keys else rows.crossJoin(F.broadcast(stats))  # noqa: E731  # without keys it is one row
            shifted = fit(df, df.groupBy(*keys).agg(F.max("v").alias("__top"))).withColumn("v", F.exp(F.col("v") - F.col("__top"))).drop("__top")
            whole = fit(shifted, shifted.groupBy(*keys).agg(F.sum("v").alias("__sum")))
            return Cells(whole.select(*self.axes, (F.col("v") / F.col("__sum")).alias("v")), self.shape)
        w = self._along(axis)
        shifted = self.df.withColumn("v", F.exp(F.col("v") - F.max("v").over(w)))
        return Cells(shifted.withColumn("v", F.col("v") / F.sum("v").over(w)), self.shape)

    def matmul(self, other: Cells, block: int = 512, small: int = SMALL) -> Cells:
        """Matrix product, batched where both have leading axes of equal size.

        A matrix of up to ``small`` cells by its shape is sent to the tasks, which multiply what they read of the
        other one by it.  Else cells meet in square blocks: a task multiplies two and returns a sum for each
        cell of their product, so that what is shuffled on is ``block`` times less than the products.  Cells
        that have no term are left out.
        """
        n, m = len(self.shape), len(other.shape)
        if n != m or n < 2 or self.shape[-1] != other.shape[-2] or self.shape[:-2] != other.shape[:-2]:
            raise ValueError(f"{self.shape} doesn't fit {other.shape}")
        if n == 2 and self.shape[1] <= SHARED:
            if prod(other.shape) <= small:
                return self._times_small(other)
            if prod(self.shape) <= small:
                return other.transpose()._times_small(self.transpose()).transpose()
        batch = axis_names(n - 2)
        blocks = lambda size: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, (size - 1) // block)).cast("long")))
        part = lambda axis: F.floor(F.col(axis) / block).alias(f"b_{axis}")
        left = self.df.select(*batch, F.col(f"i{n - 2}").alias("r"), F.col(f"i{n - 1}").alias("k"), F.col("v").cast("double").alias("x"))
        right = other.df.select(*batch, F.col(f"i{n - 2}").alias("k"), F.col(f"i{n - 1}").alias("c"), F.col("v").cast("double").alias("y"))
        left = left.select("*", part("r"), part("k"), blocks(other.shape[-1]).alias("b_c"))
        right = right.select("*", part("c"), part("k"), blocks(self.shape[-2]).alias("b_r"))
        group = [*batch, "b_r", "b_k", "b_c"]

        def multiply(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            names = [*batch, "r", "c", "v"]
            if a.empty or b.empty:
                return pd.DataFrame({c: pd.Series(dtype=float if c == "v" else np.int64) for c in names})
            rows, r = np.unique(a["r"].to_numpy(), return_inverse=True)
            columns, c = np.unique(b["c"].to_numpy(), return_inverse=True)
            low = int(a["k"].iloc[0]) // block * block
            there, sums = _product(_dense(r, a["k"].to_numpy() - low, a["x"], (len(rows), block)), _dense(c, b["k"].to_numpy() - low, b["y"], (len(columns), block)))
            i, j = np.nonzero(there)
            return pd.DataFrame({**{c: a[c].iloc[0] for c in batch}, "r": rows[i], "c": columns[j], "v": sums[i, j]}, columns=names)

        shape = ", ".join([*[f"{c} long" for c in batch], "r long", "c long", "v double"])
        parts = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(multiply, shape)
        made = parts.groupBy(*batch, F.col("r").alias(f"i{n - 2}"), F.col("c").alias(f"i{n - 1}")).agg(F.sum(F.coalesce("v", F.lit(float("nan")))).alias("v"))  # NaN comes back as null
        return Cells(made, (*self.shape[:-1], other.shape[-1]))

    def _times_small(self, other: Cells) -> Cells:
        """Matrix product by one that the driver sends to the tasks: no cell of this one is shuffled, only sums of what a task read of a row."""
        table = other.df.select("i0", "i1", F.col("v").cast("double").alias("v")).toArrow()
        width = self.shape[1]
        right = _dense(table["i1"].to_numpy(), table["i0"].to_numpy(), table["v"].to_numpy(), (other.shape[1], width))
        right = self.df.sparkSession.sparkContext.broadcast(right)
        each = max(1, (1 << 21) // max(1, *other.shape))

        def run(batches):
            for batch in batches:
                rows, r = np.unique(batch.column("r").to_numpy(), return_inverse=True)
                k, x = batch.column("k").to_numpy(), batch.column("x").to_numpy(zero_copy_only=False)
                for low in range(0, len(rows), each):
                    mine = (r >= low) & (r < low + each)
                    held = rows[low : low + each]
                    there, sums = _product(_dense(r[mine] - low, k[mine], x[mine], (len(held), width)), right.value)
                    i, j = np.nonzero(there)
                    yield pa.RecordBatch.from_arrays([pa.array(held[i]), pa.array(j.astype(np.int64)), pa.array(sums[i, j])], ["i0", "i1", "v"])

        cells = self.df.select(F.col("i0").cast("long").alias("r"), F.col("i1").cast("long").alias("k"), F.col("v").cast("double").alias("x"))
        made = cells.mapInArrow(run, "i0 long, i1 long, v double").groupBy("i0", "i1").agg(F.sum("v").alias("v"))
        return Cells(made, (self.shape[0], other.shape[1]))

    def cast(self, dtype: str) -> Cells:
        """Values as the type has them: bool is 0 or 1, whole numbers are cut towards 0 and wrap around."""
        v = F.col("v")
        if dtype == "bool":
            return Cells(self.df.withColumn("v", (v != 0).cast("double")), self.shape)
        if dtype in ("float32", "float64"):
            return Cells(self.df.withColumn("v", v.cast("float" if dtype == "float32" else "double").cast("double")), self.shape)
        bits = {"int8": 8, "uint8": 8, "int16": 16, "int32": 32}[dtype]
        half = 0 if dtype == "uint8" else 1 << (bits - 1)
        whole = F.coalesce(F.when(~F.isnan(v), scalar.trunc(v).try_cast("long")), F.lit(0))
        return Cells(self.df.withColumn("v", (F.pmod(whole + half, F.lit(1 << bits)) - half).cast("double")), self.shape)

    def logical(self, name: str, other: Cells | None = None) -> Cells:
        """``and``, ``or`` and ``not`` of what isn't 0, as 0 and 1."""
        truth = self.cast("bool")
        if name == "not":
            return Cells(truth.df.withColumn("v", 1 - F.col("v")), self.shape)
        return truth.combine({"and": "min", "or": "max"}[name], other.cast("bool"))

    def split(self, sizes: list[int], axis: int) -> list[Cells]:
        """Consecutive parts of an axis."""
        axis = self._axis(axis)
        if sum(sizes) != self.shape[axis] or min(sizes) < 0:
            raise ValueError(f"{sizes} don't add up to {self.shape[axis]}")
        ends = np.cumsum(sizes).tolist()
        return [self.slice(axis, end - size, end) for end, size in zip(ends, sizes)]

    def at(self, *index: int) -> float | None:
        """Value of one cell, negative places from the end; None where there is no such cell."""
        where = [range(n)[i] for n, i in zip(self.shape, index, strict=True)]
        df = self.df
        for a, i in zip(self.axes, where):
            df = df.where(F.col(a) == i)
        row = df.select("v").first()
        return None if row is None else row["v"]

    def item(self) -> float:
        """The only value."""
        if prod(self.shape) != 1:
            raise ValueError(f"{prod(self.shape)} values")
        return self.df.select("v").first()["v"]

    def to_array(self, most: int = 1_000_000) -> np.ndarray:
        """All values on the driver, absent cells as 0; more than ``most`` raise."""
        if prod(self.shape) > most:
            raise ValueError(f"{prod(self.shape)} cells; the most is {most}")
        table, out = self.df.toArrow(), np.zeros(self.shape)
        out[tuple(table[a].to_numpy() for a in self.axes)] = table["v"].to_numpy()
        return out

    def frobenius(self) -> float:
        return self.df.agg(F.sqrt(F.sum(F.col("v") * F.col("v")))).first()[0]


def from_vectors(df: DataFrame, row: str, vector: str, shape: tuple) -> Cells:
    """Rows of vectors as a matrix; ``row`` holds the row's index."""
    return Cells(df.select(F.col(row).cast("long").alias("i0"), F.posexplode(vector).alias("i1", "v")).select("i0", F.col("i1").cast("long").alias("i1"), F.col("v").cast("double").alias("v")), shape)


def to_vectors(cells: Cells) -> DataFrame:
    """``(i0, values)`` of a matrix; a row must fit a task."""
    pairs = F.sort_array(F.collect_list(F.struct("i1", "v")))
    return cells.df.groupBy("i0").agg(F.transform(pairs, lambda t: t["v"]).alias("values"))


def concat(parts: list[Cells], axis: int) -> Cells:
    out, size = None, 0
    for p in parts:
        moved = p.df.withColumn(f"i{axis}", F.col(f"i{axis}") + size).select(*p.axes, "v")
        out = moved if out is None else out.union(moved)
        size += p.shape[axis]
    return Cells(out, (*parts[0].shape[:axis], size, *parts[0].shape[axis + 1 :]))


def stack(parts: list[Cells], axis: int) -> Cells:
    return concat([p.unsqueeze(axis) for p in parts], axis)


def full(spark, shape: tuple, value: float) -> Cells:
    return Cells(spark.range(prod(shape)).select(F.col("id").alias("i0"), F.lit(float(value)).alias("v")), (prod(shape),)).reshape(*shape)


def arange(spark, start: float, stop: float, step: float = 1.0) -> Cells:
    """Numbers from ``start`` on, below ``stop`` (above, for a negative step)."""
    if not step:
        raise ValueError("the step is 0")
    n = max(0, int(np.ceil((stop - start) / step)))
    return Cells(spark.range(n).select(F.col("id").alias("i0"), (F.col("id") * float(step) + float(start)).alias("v")), (n,))


def unit_random(seed: int, place: Column, draw: int = 0) -> Column:
    """A number in [0, 1) that depends on seed, place and draw only: 52 bits of their MD5 digest."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(draw)), place.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def _random(spark, shape: tuple, value) -> Cells:
    flat = spark.range(prod(shape)).select(F.col("id").alias("i0"), value(F.col("id")).alias("v"))
    return Cells(flat, (prod(shape),)).reshape(*shape)


def random_cells(spark, shape: tuple, seed: int, low: float = 0.0, high: float = 1.0) -> Cells:
    """Uniform values that depend on seed and place only, not on partitions."""
    return _random(spark, shape, lambda i: unit_random(seed, i) * (high - low) + low)


def random_normal(spark, shape: tuple, seed: int, mean: float = 0.0, std: float = 1.0) -> Cells:
    """Normal values by Box and Muller's transform of two uniform ones."""
    radius = lambda i: F.sqrt(-2.0 * F.ln(1.0 - unit_random(seed, i, 1)))
    return _random(spark, shape, lambda i: radius(i) * F.cos(2 * np.pi * unit_random(seed, i, 2)) * std + mean)


def random_integers(spark, shape: tuple, seed: int, low: int, high: int) -> Cells:
    """Whole numbers from ``low`` on, below ``high``."""
    if low >= high:
        raise ValueError("low is not below high")
    return _random(spark, shape, lambda i: F.floor(unit_random(seed, i, 3) * (high - low)) + float(low))
