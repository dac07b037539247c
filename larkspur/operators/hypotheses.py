"""Hypothesis tests: statistics as partial aggregates, p-values as columns; one row, or one for each group of ``keys``.

Nulls don't count.  Where a statistic isn't defined (too few values, no spread) it and p are null or NaN.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import special


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def two_sided_t(t: Column, df: Column) -> Column:
    return special.regularized_beta(df / (df + t * t), df / 2, F.lit(0.5))


def t_test(df: DataFrame, value: str, mean: float, *keys: str) -> DataFrame:
    """``(keys, n, t, df, p)``: whether a mean is ``mean``, two-sided."""
    x = F.col(value).cast("double")
    made = df.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.stddev_samp(x).alias("s"))
    made = made.select(*keys, "n", _ratio((F.col("m") - mean) * F.sqrt("n"), F.col("s")).alias("t"), (F.col("n") - 1).cast("double").alias("df"))
    return made.withColumn("p", two_sided_t(F.col("t"), F.col("df")))


def paired_t_test(df: DataFrame, one: str, two: str, *keys: str) -> DataFrame:
    """``t_test`` of the differences of two columns against 0."""
    return t_test(df.select(*keys, (F.col(one).cast("double") - F.col(two).cast("double")).alias("_d")), "_d", 0.0, *keys)


def two_sample_t_test(df: DataFrame, value: str, group: str, one, two, *keys: str, equal_variance: bool = False) -> DataFrame:
    """``(keys, t, df, p)``: whether two groups have one mean; by Welch, or with pooled variance."""
    g = lambda k, f: f(F.when(F.col(group) == k, F.col(value).cast("double")))
    made = [g(k, f).alias(n + s) for k, s in ((one, "a"), (two, "b")) for f, n in ((F.avg, "m"), (F.var_samp, "v"), (F.count, "n"))]
    a = df.where(F.col(group).isin(one, two)).groupBy(*keys).agg(*made)
    na, nb, va, vb = (F.col(c).cast("double") for c in ("na", "nb", "va", "vb"))
    if equal_variance:
        freedom = na + nb - 2
        error = F.sqrt(((na - 1) * va + (nb - 1) * vb) / freedom * (1 / na + 1 / nb))
    else:
        ra, rb = va / na, vb / nb
        freedom, error = _ratio((ra + rb) * (ra + rb), ra * ra / (na - 1) + rb * rb / (nb - 1)), F.sqrt(ra + rb)
    known = (na > 1) & (nb > 1)
    made = a.select(*keys, F.when(known, _ratio(F.col("ma") - F.col("mb"), error)).alias("t"), F.when(known, freedom).alias("df"))
    return made.withColumn("p", two_sided_t(F.col("t"), F.col("df")))


def analysis_of_variance(df: DataFrame, value: str, group: str) -> DataFrame:
    """``(f, df_between, df_within, p)``: whether all groups have one mean.  Groups are summed first, a row a group goes on."""
    x = F.col(value).cast("double")
    groups = df.where(F.col(group).isNotNull() & x.isNotNull()).groupBy(group).agg(F.count("*").cast("double").alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v"))
    sums = groups.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("nm"), F.sum(F.col("n") * F.col("v")).alias("within"))
    about = groups.crossJoin(F.broadcast(sums.select((F.col("nm") / F.col("n")).alias("all")))).agg(F.sum(F.col("n") * (F.col("m") - F.col("all")) * (F.col("m") - F.col("all"))).alias("between"))  # one row each
    made = sums.crossJoin(F.broadcast(about)).select(
        (F.col("k") - 1).cast("double").alias("df_between"), (F.col("n") - F.col("k")).alias("df_within"), "between", "within"
    )
    f = F.when((F.col("df_between") > 0) & (F.col("df_within") > 0), _ratio(F.col("between") / F.col("df_between"), F.col("within") / F.col("df_within")))
    m, n = F.col("df_between"), F.col("df_within")
    tail = special.regularized_beta(n / (n + m * F.col("f")), n / 2, m / 2)  # the upper tail itself
    return made.withColumn("f", f).select("f", "df_between", "df_within", tail.alias("p"))


def chi_square_fit(df: DataFrame, observed: str, expected: str, *keys: str, lost: int = 0) -> DataFrame:
    """``(keys, chi2, df, p)``: whether counts fit expected ones; ``lost`` degrees of freedom went into the latter."""
    o, e = F.col(observed).cast("double"), F.col(expected).cast("double")
    made = df.groupBy(*keys).agg(F.sum((o - e) * (o - e) / F.when(e != 0, e)).alias("chi2"), (F.count(o) - 1 - lost).cast("double").alias("df"))
    return made.withColumn("p", special.regularized_gamma_q(F.col("df") / 2, F.col("chi2") / 2))


def chi_square_independence(df: DataFrame, one: str, two: str) -> DataFrame:
    """``(chi2, df, p)``: whether two columns are independent.  From counts a cell, all rows and columns of the table, empty cells too: the sum of o * o / e less n."""
    known = df.where(F.col(one).isNotNull() & F.col(two).isNotNull())
    cells = known.groupBy(F.col(one).alias("a"), F.col(two).alias("b")).agg(F.count("*").cast("double").alias("o"))
    sides = [cells.groupBy(c).agg(F.sum("o").alias(f"n_{c}")) for c in ("a", "b")]
    both = reduce(lambda x, s: x.join(s, s.columns[0]), sides, cells)
    sums = both.agg(F.sum("o").alias("n"), F.sum(F.col("o") * F.col("o") / (F.col("n_a") * F.col("n_b"))).alias("r"), F.count_distinct("a").alias("rows"), F.count_distinct("b").alias("columns"))
    made = sums.select((F.col("n") * (F.col("r") - 1)).alias("chi2"), ((F.col("rows") - 1) * (F.col("columns") - 1)).cast("double").alias("df"))
    return made.withColumn("p", special.regularized_gamma_q(F.col("df") / 2, F.greatest(F.col("chi2"), F.lit(0.0)) / 2))


def correlation_test(df: DataFrame, one: str, two: str, *keys: str) -> DataFrame:
    """``(keys, r, t, df, p)``: whether two columns are correlated."""
    known = df.where(F.col(one).isNotNull() & F.col(two).isNotNull())
    made = known.groupBy(*keys).agg(F.corr(one, two).alias("r"), (F.count("*") - 2).cast("double").alias("df"))
    made = made.withColumn("t", F.when(F.col("df") > 0, _ratio(F.col("r") * F.sqrt("df"), F.sqrt(1 - F.col("r") * F.col("r")))))
    return made.select(*keys, "r", "t", "df", two_sided_t(F.col("t"), F.col("df")).alias("p"))
