"""Special functions, distributions and tests against closed forms and plain sums."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.functions import special
from larkspur.operators import hypotheses


def values(spark, points, **columns):
    df = spark.createDataFrame([(float(x),) for x in points], "x double")
    return df.select("x", *[c.alias(n) for n, c in columns.items()]).orderBy("x").collect()


def test_gamma_functions(spark):
    x = F.col("x")
    got = values(spark, [0.01, 0.3, 1, 2.5, 9.99, 10, 60, 170], ln=special.ln_gamma(x), g=special.gamma(x), b=special.beta(x, 2.5), p=special.regularized_gamma_p(3, x), q=special.regularized_gamma_q(3, x), half=special.regularized_gamma_q(0.5, x))
    for r in got:
        assert r.ln == pytest.approx(math.lgamma(r.x), rel=1e-13, abs=1e-14) and r.g == pytest.approx(math.gamma(r.x), rel=1e-12)
        assert r.b == pytest.approx(math.exp(math.lgamma(r.x) + math.lgamma(2.5) - math.lgamma(r.x + 2.5)), rel=1e-12)
        assert r.q == pytest.approx(math.exp(-r.x) * (1 + r.x + r.x * r.x / 2), rel=1e-12) and r.p + r.q == pytest.approx(1)
        assert r.half == pytest.approx(math.erfc(math.sqrt(r.x)), rel=1e-12)
    got = values(spark, [-2.5, -2, -0.5, 0], g=special.gamma(x), ln=special.ln_gamma(x))
    assert got[0].g == pytest.approx(math.gamma(-2.5)) and math.isnan(got[1].g) and got[2].g == pytest.approx(math.gamma(-0.5)) and got[3].ln == math.inf
    none = spark.range(1).select(special.ln_gamma(F.lit(None)).alias("a"), special.regularized_beta(F.lit(None), 1, 1).alias("b"), special.regularized_gamma_p(-1, 2).alias("c")).first()
    assert none.a is None and none.b is None and math.isnan(none.c)


def plain_beta(x, a, b, n=200_000):
    """By the midpoint rule after t = x * u ** 2, for a and b of at least 1 / 2 and x below 1."""
    u = (np.arange(n) + 0.5) / n
    t = x * u * u
    return float(np.exp((a - 1) * np.log(t) + (b - 1) * np.log1p(-t) + np.log(2 * x * u) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))).sum() / n)


@pytest.mark.parametrize("a, b", [(0.5, 0.5), (2, 3), (30, 7.5), (900, 0.5), (1000, 1200)])
def test_incomplete_beta(spark, a, b):
    for r in values(spark, [0, 0.02, 0.3, 0.45, 0.8, 0.97, 1], i=special.regularized_beta(F.col("x"), a, b)):
        assert r.i == pytest.approx(0 if r.x == 0 else 1 if r.x == 1 else plain_beta(r.x, a, b), rel=1e-5, abs=1e-9)


def test_large_parameters(spark):
    got = spark.range(1).select(special.regularized_gamma_p(1e6, 1e6).alias("p"), special.student_t(2e6).cdf(1.5).alias("t"), special.poisson(1e5).cdf(1e5).alias("k")).first()
    assert got.p == pytest.approx(0.5 + 1 / (3 * math.sqrt(2 * math.pi * 1e6)), abs=1e-7) and got.t == pytest.approx(0.5 * math.erfc(-1.5 / math.sqrt(2)), abs=1e-6) and got.k == pytest.approx(0.5 + 2 / (3 * math.sqrt(2 * math.pi * 1e5)), abs=1e-5)


CASES = lambda: {
    "normal": (special.normal(1, 2), [-9, -1, 0.5, 3, 8]),
    "exponential": (special.exponential(0.5), [0, 0.1, 2, 9]),
    "gamma": (special.gamma_distribution(2.5, 3), [0.2, 4, 25]),
    "chi_square": (special.chi_square(4), [0.3, 3, 20]),
    "beta": (special.beta_distribution(2, 5), [0.1, 0.4, 0.9]),
    "student": (special.student_t(3), [-8, -1, 0, 2, 15]),
    "f": (special.f_distribution(4, 9), [0.2, 1, 6]),
}


@pytest.mark.parametrize("name", ["normal", "exponential", "gamma", "chi_square", "beta", "student", "f"])
def test_continuous_distributions(spark, name):
    """The density is the slope of the distribution function, and the quantile its inverse."""
    d, points = CASES()[name]
    x, h = F.col("x"), 1e-5
    for r in values(spark, points, f=d.pdf(x), slope=(d.cdf(x + h) - d.cdf(x - h)) / (2 * h), back=d.quantile(d.cdf(x)), below=d.cdf(F.lit(d.low if math.isfinite(d.low) else -1e9) - 1)):
        if r.x > d.low:
            assert r.f == pytest.approx(r.slope, rel=1e-4, abs=1e-9) and r.back == pytest.approx(r.x, rel=1e-5)
        assert abs(r.below) < 1e-12
    ends = spark.range(1).select(d.quantile(0).alias("a"), d.quantile(1).alias("b"), d.quantile(2).alias("c")).first()
    assert ends.a == d.low and ends.b == d.high and math.isnan(ends.c)


@pytest.mark.parametrize("name", ["poisson", "binomial"])
def test_whole_numbers(spark, name):
    d = special.poisson(3.5) if name == "poisson" else special.binomial(12, 0.3)
    mass = (lambda k: math.exp(-3.5) * 3.5**k / math.factorial(k)) if name == "poisson" else (lambda k: math.comb(12, k) * 0.3**k * 0.7 ** (12 - k) if k <= 12 else 0)
    x = F.col("x")
    total = 0
    for r in values(spark, range(13), f=d.pdf(x), off=d.pdf(x + 0.5), c=d.cdf(x), mid=d.cdf(x + 0.5), at=d.quantile(d.cdf(x) - 1e-9)):
        total += mass(int(r.x))
        assert r.f == pytest.approx(mass(int(r.x)), rel=1e-11) and r.off == 0 and r.c == pytest.approx(total) == r.mid and r.at == r.x


def test_tests(spark):
    rng = random.Random(4)
    rows = [(g, rng.gauss({"a": 0, "b": 0.4, "c": 0.1}[g], {"a": 1, "b": 2, "c": 1}[g]), rng.gauss(0, 1), f"{rng.choice('xyz')}") for g in "abc" for _ in range(40)] + [("a", None, 1.0, "x"), (None, 1.0, None, None)]
    df = spark.createDataFrame(rows, "g string, v double, w double, k string").repartition(3)
    a, b = (np.array([v for g, v, *_ in rows if g == x and v is not None]) for x in "ab")
    r = hypotheses.two_sample_t_test(df, "v", "g", "a", "b").first()
    ra, rb = a.var(ddof=1) / len(a), b.var(ddof=1) / len(b)
    assert r.t == pytest.approx((a.mean() - b.mean()) / math.sqrt(ra + rb)) and r.df == pytest.approx((ra + rb) ** 2 / (ra**2 / (len(a) - 1) + rb**2 / (len(b) - 1)))
    tail = lambda t, v: plain_beta(v / (v + t * t), v / 2, 0.5, 2_000_000)
    assert r.p == pytest.approx(tail(r.t, r.df), rel=1e-3)
    pooled = hypotheses.two_sample_t_test(df, "v", "g", "a", "b", equal_variance=True).first()
    assert pooled.df == len(a) + len(b) - 2
    one = hypotheses.t_test(df.where("g = 'a'"), "v", 0.2).first()
    assert one.n == 40 and one.t == pytest.approx((a.mean() - 0.2) * math.sqrt(40) / a.std(ddof=1)) and one.p == pytest.approx(tail(one.t, 39), rel=1e-3)
    pair = hypotheses.paired_t_test(df, "v", "w").first()
    assert pair.n == 120
    v = hypotheses.analysis_of_variance(df, "v", "g").first()
    groups = [np.array([x[1] for x in rows if x[0] == g and x[1] is not None]) for g in "abc"]
    every = np.concatenate(groups)
    between, within = sum(len(g) * (g.mean() - every.mean()) ** 2 for g in groups), sum(((g - g.mean()) ** 2).sum() for g in groups)
    assert v.f == pytest.approx((between / 2) / (within / 117)) and (v.df_between, v.df_within) == (2, 117) and v.p == pytest.approx((1 + 2 * v.f / 117) ** (-117 / 2))
    chi = hypotheses.chi_square_independence(df, "g", "k").first()
    table = np.array([[sum(1 for x in rows if x[0] == g and x[3] == k) for k in "xyz"] for g in "abc"], float)
    expected = table.sum(1, keepdims=True) * table.sum(0) / table.sum()
    assert chi.chi2 == pytest.approx(((table - expected) ** 2 / expected).sum()) and chi.df == 4 and chi.p == pytest.approx(math.exp(-chi.chi2 / 2) * (1 + chi.chi2 / 2))
    fit = hypotheses.chi_square_fit(spark.createDataFrame([(10, 12.0), (20, 18.0), (30, 30.0)], "o int, e double"), "o", "e").first()
    assert fit.chi2 == pytest.approx(4 / 12 + 4 / 18) and fit.df == 2 and fit.p == pytest.approx(math.exp(-fit.chi2 / 2))
    c = hypotheses.correlation_test(df, "v", "w", "g").where("g = 'a'").first()
    both = np.array([(x[1], x[2]) for x in rows if x[0] == "a" and x[1] is not None])
    assert c.r == pytest.approx(np.corrcoef(both.T)[0, 1]) and c.df == 38 and c.p == pytest.approx(tail(c.t, 38), rel=1e-3)
    nothing = hypotheses.t_test(df.limit(0), "v", 0.0).first()
    assert nothing.n == 0 and nothing.t is None and nothing.p is None
