"""Registered queries of distributions and hypothesis tests, and their SQL twins by plain series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import special
from ..operators import hypotheses
from .registry import _t, query


def gamma_p_sql(a: str, x: str) -> str:
    """Regularized lower gamma by its series of positive terms."""
    return f"(CASE WHEN ({x}) <= 0 THEN 0 ELSE least(1, list_sum(list_transform(range(0, 600), lambda k: exp((({a}) + k) * ln({x}) - ({x}) - lgamma(({a}) + k + 1))))) END)"


def beta_sql(x: str, a: str, b: str) -> str:
    """Regularized beta by its series of positive terms, from the side where it is short."""

    def series(x: str, a: str, b: str) -> str:
        front = f"({a}) * ln({x}) + ({b}) * ln(1 - ({x})) - ln({a}) - lgamma({a}) - lgamma({b}) + lgamma({a} + {b})"
        return f"list_sum(list_transform(range(0, 3000), lambda k: exp({front} + lgamma(({a}) + ({b}) + k) - lgamma(({a}) + ({b})) - lgamma(({a}) + 1 + k) + lgamma(({a}) + 1) + k * ln({x}))))"

    return f"(CASE WHEN ({x}) <= 0 THEN 0 WHEN ({x}) >= 1 THEN 1 WHEN ({x}) < 0.5 THEN {series(x, a, b)} ELSE 1 - {series(f'1 - ({x})', b, a)} END)"


PLACES = 8


@query(
    "distribution_values",
    f"""WITH s AS (SELECT p_partkey, p_size::DOUBLE AS x FROM part), d AS (SELECT DISTINCT x FROM s),
       v AS (SELECT x, {gamma_p_sql('5.0::DOUBLE', 'x / 2')} AS chi_square, {gamma_p_sql('2.5::DOUBLE', 'x / 3')} AS gamma, 1 - {gamma_p_sql('x + 1', '12.0::DOUBLE')} AS poisson,
         CASE WHEN x >= 60 THEN 1 ELSE {beta_sql('0.6::DOUBLE', '(60 - x)', '(x + 1)')} END AS binomial, {beta_sql('x / 51', '2.0::DOUBLE', '3.0::DOUBLE')} AS beta,
         {beta_sql('(5 * x / 10) / (5 * x / 10 + 12)', '2.5::DOUBLE', '6.0::DOUBLE')} AS f, {beta_sql('7 / (7 + (x - 25) * (x - 25) / 100)', '3.5::DOUBLE', '0.5::DOUBLE')} / 2 AS t_tail FROM d)
       SELECT p_partkey, round(chi_square, {PLACES}) AS chi_square, round(gamma, {PLACES}) AS gamma, round(poisson, {PLACES}) AS poisson, round(binomial, {PLACES}) AS binomial, round(beta, {PLACES}) AS beta,
         round(f, {PLACES}) AS f, round(CASE WHEN s.x < 25 THEN t_tail ELSE 1 - t_tail END, {PLACES}) AS student FROM s JOIN v ON s.x = v.x""",
)
def distribution_values(spark, sf_dir):
    """Distribution functions of a column; values that come again are computed once."""
    x = F.col("x")
    made = {
        "chi_square": special.chi_square(10).cdf(x), "gamma": special.gamma_distribution(2.5, 3.0).cdf(x), "poisson": special.poisson(12).cdf(x), "binomial": special.binomial(60, 0.4).cdf(x),
        "beta": special.beta_distribution(2, 3).cdf(x / 51), "f": special.f_distribution(5, 12).cdf(x / 10), "student": special.student_t(7).cdf((x - 25) / 10),
    }
    parts = _t(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"))
    values = parts.select("x").distinct().select("x", *[F.round(v, PLACES).alias(n) for n, v in made.items()])
    return parts.join(values, "x").drop("x")


@query(
    "quantile_values",
    f"""WITH s AS (SELECT DISTINCT p_size AS k, p_size / 51.0::DOUBLE AS p FROM part) SELECT k, round(p, {PLACES}) AS chi_square, round(p, {PLACES}) AS student, round(p, {PLACES}) AS normal, round(-ln(1 - p) / 0.7, {PLACES}) AS exponential FROM s""",
)
def quantile_values(spark, sf_dir):
    """Quantiles, put back into their distribution function where that has no short inverse."""
    p = F.col("p")
    sizes = _t(spark, sf_dir, "part").select(F.col("p_size").alias("k"), (F.col("p_size") / 51.0).alias("p")).distinct()
    made = {"chi_square": special.chi_square(3), "student": special.student_t(4), "normal": special.normal(5, 2)}
    back = [F.round(d.cdf(d.quantile(p)), PLACES).alias(n) for n, d in made.items()]
    return sizes.select("k", *back, F.round(special.exponential(0.7).quantile(p), PLACES).alias("exponential"))


@query(
    "group_means_test",
    f"""WITH g AS (SELECT o_orderstatus, avg(o_totalprice) FILTER (o_orderpriority = '1-URGENT') AS ma, var_samp(o_totalprice) FILTER (o_orderpriority = '1-URGENT') AS va, (count(o_totalprice) FILTER (o_orderpriority = '1-URGENT'))::DOUBLE AS na,
         avg(o_totalprice) FILTER (o_orderpriority = '5-LOW') AS mb, var_samp(o_totalprice) FILTER (o_orderpriority = '5-LOW') AS vb, (count(o_totalprice) FILTER (o_orderpriority = '5-LOW'))::DOUBLE AS nb FROM orders GROUP BY 1),
       s AS (SELECT o_orderstatus, (ma - mb) / sqrt(va / na + vb / nb) AS t, pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)) AS df FROM g)
       SELECT o_orderstatus, round(t, {PLACES}) AS t, round(df, 5) AS df, round({beta_sql('df / (df + t * t)', 'df / 2', '0.5::DOUBLE')}, 6) AS p FROM s""",
)
def group_means_test(spark, sf_dir):
    made = hypotheses.two_sample_t_test(_t(spark, sf_dir, "orders"), "o_totalprice", "o_orderpriority", "1-URGENT", "5-LOW", "o_orderstatus")
    return made.select("o_orderstatus", F.round("t", PLACES).alias("t"), F.round("df", 5).alias("df"), F.round("p", 6).alias("p"))


@query(
    "variance_of_priorities",
    f"""WITH g AS (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS m, var_pop(o_totalprice) AS v FROM orders GROUP BY 1), a AS (SELECT avg(o_totalprice) AS m FROM orders),
       s AS (SELECT (count(*) - 1)::DOUBLE AS d1, (sum(n) - count(*))::DOUBLE AS d2, sum(n * pow(g.m - a.m, 2)) AS b, sum(n * v) AS w FROM g, a), f AS (SELECT d1, d2, (b / d1) / (w / d2) AS f FROM s)
       SELECT round(f, {PLACES}) AS f, d1 AS df_between, d2 AS df_within, round(1 - {beta_sql('d1 * f / (d1 * f + d2)', 'd1 / 2', 'd2 / 2')}, 6) AS p FROM f""",
)
def variance_of_priorities(spark, sf_dir):
    made = hypotheses.analysis_of_variance(_t(spark, sf_dir, "orders"), "o_totalprice", "o_orderpriority")
    return made.select(F.round("f", PLACES).alias("f"), "df_between", "df_within", F.round("p", 6).alias("p"))


@query(
    "independence_of_priorities",
    f"""WITH c AS (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*)::DOUBLE AS o FROM orders GROUP BY 1, 2), n AS (SELECT sum(o) AS n FROM c), r AS (SELECT a, sum(o) AS n FROM c GROUP BY 1), k AS (SELECT b, sum(o) AS n FROM c GROUP BY 1),
       s AS (SELECT sum(pow(coalesce(o, 0) - r.n * k.n / n.n, 2) / (r.n * k.n / n.n)) AS chi2, ((count(DISTINCT r.a) - 1) * (count(DISTINCT k.b) - 1))::DOUBLE AS df FROM r CROSS JOIN k CROSS JOIN n LEFT JOIN c ON c.a = r.a AND c.b = k.b)
       SELECT round(chi2, 6) AS chi2, df, round(1 - {gamma_p_sql('df / 2', 'chi2 / 2')}, 6) AS p FROM s""",
)
def independence_of_priorities(spark, sf_dir):
    made = hypotheses.chi_square_independence(_t(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus")
    return made.select(F.round("chi2", 6).alias("chi2"), "df", F.round("p", 6).alias("p"))


@query(
    "correlation_tests",
    f"""WITH g AS (SELECT event_type, corr(value, event_id % 7) AS r, (count(*) - 2)::DOUBLE AS df FROM events GROUP BY 1), s AS (SELECT *, r * sqrt(df) / sqrt(1 - r * r) AS t FROM g)
       SELECT event_type, round(r, {PLACES}) AS r, round(t, {PLACES}) AS t, df, round({beta_sql('df / (df + t * t)', 'df / 2', '0.5::DOUBLE')}, 6) AS p FROM s""",
)
def correlation_tests(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_type", "value", (F.col("event_id") % 7).cast("double").alias("day"))
    return hypotheses.correlation_test(e, "value", "day", "event_type").select("event_type", *[F.round(c, k).alias(c) for c, k in (("r", PLACES), ("t", PLACES), ("df", 0), ("p", 6))])
