"""Statistics of columns, by group where keys are given.

All but the percentiles are partial aggregates.  Exact percentiles come from counts of equal values and
the places these have in their group's order, so that no group's values meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import running


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of equal keys, null keys too; ``right`` has a row a key."""
    other = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], F.lit(True))
    return left.join(other, same, "left").drop(*[f"__{k}" for k in keys])


def percentiles(df: DataFrame, value: str, shares: dict[str, float], *keys: str) -> DataFrame:
    """Keys, and a column for each exact percentile (``shares`` from 0 to 1), linear between neighbours; null where a group has no value."""
    if not all(0 <= p <= 1 for p in shares.values()):
        raise ValueError("shares are from 0 to 1")
    rows = df.select(*keys, F.col(value).cast("double").alias("__v"))
    counts = rows.where("__v IS NOT NULL").groupBy(*keys, "__v").agg(F.count("*").alias("__n"))
    placed = running(counts, "__v", "__before", keys=keys, amount="__n")
    groups = rows.groupBy(*keys).agg(F.count("__v").alias("__all"))
    placed = _joined(groups, placed, keys)
    made = []
    for name, p in shares.items():
        rank = (F.col("__all") - 1) * F.lit(float(p))
        at = lambda r: F.max(F.when((F.col("__before") <= r) & (r < F.col("__before") + F.col("__n")), F.col("__v")))
        low, high = at(F.floor(rank)), at(F.ceil(rank))
        made.append((low + (high - low) * F.max(rank - F.floor(rank))).alias(name))
    return placed.groupBy(*keys).agg(*made)


def summary(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Count, mean, both deviations (the sample one is 0 for one value), extremes and exact median."""
    v = F.col(value).cast("double")
    rest = df.groupBy(*keys).agg(
        F.count(v).alias("count"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("population_std"),
        F.when(F.count(v) == 1, 0.0).otherwise(F.stddev_samp(v)).alias("sample_std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    )
    return _joined(rest, percentiles(df, value, {"median": 0.5}, *keys), keys)


def correlation(x: str, y: str) -> Column:
    return F.corr(x, y)


def linear_regression(df: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """Slope and intercept of y on x."""
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def normal_density(x: Column, mean: float = 0.0, std: float = 1.0) -> Column:
    z = (x - mean) / std
    return F.exp(-z * z / 2) / (std * (2 * 3.141592653589793) ** 0.5)


def poisson_mass(k: Column, rate: float) -> Column:
    """Probability of k events; the factorial by its logarithm."""
    log_factorial = F.aggregate(F.when(k >= 1, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, i: s + F.ln(i.cast("double")))
    return F.exp(k * F.ln(F.lit(float(rate))) - rate - log_factorial)


def welch_t(df: DataFrame, value: str, group: str, one, two) -> DataFrame:
    """t statistic and degrees of freedom of the difference in means of two groups of unequal variance."""
    g = lambda k, f: f(F.when(F.col(group) == k, F.col(value).cast("double")))
    made = [f(k).alias(n + s) for k, s in ((one, "a"), (two, "b")) for f, n in ((lambda k: g(k, F.avg), "m"), (lambda k: g(k, F.var_samp), "v"), (lambda k: g(k, F.count), "n"))]
    a = df.agg(*made)
    ra, rb = F.col("va") / F.col("na"), F.col("vb") / F.col("nb")
    return a.select(((F.col("ma") - F.col("mb")) / F.sqrt(ra + rb)).alias("t"), ((ra + rb) * (ra + rb) / (ra * ra / (F.col("na") - 1) + rb * rb / (F.col("nb") - 1))).alias("df"))
