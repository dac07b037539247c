"""Registered queries over the shared tables and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar, traced, units
from ..functions.expr import col, fn, int64, lit
from ..operators import graph, linalg, signal, stats, training
from ..operators import vectors as V
from ..operators.coordinates import Cells, from_vectors
from ..operators.frame import Frame, concat, desc
from ..sources import parquet
from ..streaming.dataset import Dataset, collate_scalars, collate_vectors, collate_xy, ranked, windowed_events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


@query(
    "pricing_summary",
    """SELECT l_returnflag, count(*) AS n, coalesce(sum(l_extendedprice), 0) AS total, avg(l_discount) AS avg_disc,
       CASE WHEN count(l_tax) = 1 THEN 0 ELSE stddev_samp(l_tax) END AS sd_tax
       FROM lineitem WHERE l_quantity >= 25 GROUP BY 1""",
)
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {"n": fn.count(), "total": fn.sum(col("l_extendedprice")), "avg_disc": fn.mean(col("l_discount")), "sd_tax": fn.stddev(col("l_tax"))}
    return _frame(spark, sf_dir, "lineitem").filter(col("l_quantity").gte(25)).group_by("l_returnflag").aggregate(spec).df


def erf_sql(x: str) -> str:
    """erf by its series of positive terms; beyond 6 it is 1 to the last digit."""
    series = f"2 / sqrt(pi()) * exp(-({x}) * ({x})) * list_sum(list_transform(range(0, 120), lambda n: exp(n * ln(4) + lgamma(n + 1) - lgamma(2 * n + 2)) * pow(({x}), 2 * n + 1)))"
    return f"(CASE WHEN abs({x}) > 6 THEN sign({x}) ELSE {series} END)"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _frame(spark, sf_dir, name, order=None) -> Frame:
    return Frame(_t(spark, sf_dir, name), order)


# --- projection, filter, expressions ---


@query("select_rename_drop", "SELECT c_custkey AS id, c_acctbal AS balance FROM customer")
def select_rename_drop(spark, sf_dir):
    return _frame(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_name").drop("c_name", "nothing").rename({"c_custkey": "id", "c_acctbal": "balance"}).df


@query(
    "filter_logic",
    """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
       WHERE (l_quantity >= 45 AND NOT (l_discount > 0.05)) OR (l_returnflag = 'R' AND l_tax <> 0.0 AND l_quantity < 3)""",
)
def filter_logic(spark, sf_dir):
    keep = (col("l_quantity").gte(45).and_(col("l_discount").gt(0.05).not_())).or_(col("l_returnflag").eq("R").and_(col("l_tax").ne(0)).and_(col("l_quantity").lt(3)))
    return _frame(spark, sf_dir, "lineitem").filter(keep).select("l_orderkey", "l_linenumber", "l_quantity").df


@query(
    "computed_columns",
    """SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_orderkey + l_partkey AS whole_sum,
       l_orderkey // 7 AS whole_quotient, l_extendedprice / l_quantity AS unit_price, l_linenumber + 0.5::DOUBLE AS shifted FROM lineitem""",
)
def computed_columns(spark, sf_dir):
    f = _frame(spark, sf_dir, "lineitem").with_columns(
        {
            "net": col("l_extendedprice") * (lit(1) - col("l_discount")),
            "whole_sum": col("l_orderkey") + col("l_partkey"),
            "whole_quotient": col("l_orderkey").div(int64(7)),
            "unit_price": col("l_extendedprice").div(col("l_quantity")),
            "shifted": col("l_linenumber").add(0.5),
        }
    )
    return f.select("l_orderkey", "l_linenumber", "net", "whole_sum", "whole_quotient", "unit_price", "shifted").df


@query(
    "nulls",
    """SELECT event_id, coalesce(v, -1.0) AS v FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v, event_type FROM events) WHERE event_type IS NOT NULL""",
)
def nulls(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"), "event_type")
    return Frame(e).drop_null("event_type").fill_null({"v": -1.0}).drop("event_type").df


@query(
    "null_counts",
    """SELECT 'event_id' AS name, count(*) FILTER (WHERE event_id IS NULL) AS nulls, count(*) AS rows FROM events
       UNION ALL SELECT 'v', count(*) FILTER (WHERE event_id % 7 = 0), count(*) FROM events UNION ALL SELECT 'event_type', count(*) FILTER (WHERE event_type IS NULL), count(*) FROM events""",
)
def null_counts(spark, sf_dir):
    e = Frame(_t(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"), "event_type"))
    rows = e.length()
    return spark.createDataFrame([(name, nulls, rows) for name, nulls in e.null_count().items()], "name string, nulls long, rows long")


@query(
    "over_all",
    "SELECT c_custkey, c_acctbal - (SELECT avg(c_acctbal) FROM customer) AS deviation FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)",
)
def over_all(spark, sf_dir):
    mean = fn.mean(col("c_acctbal")).over_all()
    f = _frame(spark, sf_dir, "customer").with_columns({"deviation": col("c_acctbal") - mean})
    return f.filter(col("c_acctbal").gt(mean)).select("c_custkey", "deviation").df


@query("months", "SELECT month(ts)::INT AS month, count(*) AS n, sum(value) AS total FROM events GROUP BY 1")
def months(spark, sf_dir):
    return _frame(spark, sf_dir, "events").with_columns({"month": fn.month(col("ts"))}).group_by("month").aggregate({"n": fn.count(), "total": fn.sum(col("value"))}).df


SCALAR_SQL = {
    "sin": "sin(x)", "cos": "cos(x)", "tan": "tan(x)", "exp": "exp(x)", "ln": "ln(x)", "sqrt": "sqrt(x)", "asin": "asin(x / 4)", "acos": "acos(x / 4)", "atan": "atan(x)", "sinh": "sinh(x)", "cosh": "cosh(x)", "tanh": "tanh(x)",
    "cot": "1 / tan(x)", "sec": "1 / cos(x)", "csc": "1 / sin(x)", "asinh": "asinh(x)", "acosh": "acosh(x + 1)", "atanh": "atanh(x / 4)", "coth": "1 / tanh(x)", "sech": "1 / cosh(x)", "csch": "1 / sinh(x)", "acot": "atan(1 / x)",
    "asec": "acos(1 / (x + 1))", "acsc": "asin(1 / (x + 1))", "acoth": "atanh(1 / (x + 1))", "asech": "acosh(4 / x)", "acsch": "asinh(1 / x)", "abs": "abs(x - 2)", "log10": "log10(x)", "log2": "log2(x)", "cbrt": "cbrt(x)",
    "floor": "floor(x)", "ceil": "ceil(x)", "round": "floor(x + 0.5)", "sign": "sign(x - 2)::DOUBLE", "trunc": "trunc(x + 2)", "expm1": "exp(x) - 1", "log1p": "ln(1 + x)", "sigmoid": "1 / (1 + exp(-x))", "relu": "greatest(x - 2, 0)",
}
SHIFTS = {"asin": (0.25, 0), "acos": (0.25, 0), "acosh": (1, 1), "atanh": (0.25, 0), "asec": (1, 1), "acsc": (1, 1), "acoth": (1, 1), "asech": (0.25, 0), "abs": (1, -2), "sign": (1, -2), "trunc": (1, 2), "relu": (1, -2)}


@query("scalar_functions", f"SELECT p_partkey, {', '.join(f'round({s}, 8) AS f_{n}' for n, s in SCALAR_SQL.items())} FROM (SELECT p_partkey, p_retailprice / 1000 + 0.25 AS x FROM part)")
def scalar_functions(spark, sf_dir):
    x = (col("p_retailprice") / 1000).add(0.25)
    made = {}
    for n in SCALAR_SQL:
        a, b = SHIFTS.get(n, (1, 0))
        made[f"f_{n}"] = getattr(fn, n)(x * a + b)
    df = _frame(spark, sf_dir, "part").with_columns(made).select("p_partkey", *made).df
    return df.select("p_partkey", *[F.round(c, 8).alias(c) for c in made])


@query(
    "erf_gelu",
    f"""SELECT event_id, {erf_sql("x")} AS erf, round(greatest(1 - {erf_sql("x")}, 0), 9) AS erfc, 0.5 * x * (1 + {erf_sql("x / sqrt(2)")}) AS gelu,
        0.5 * x * (1 + tanh(sqrt(2 / pi()) * (x + 0.044715 * x * x * x))) AS gelu_tanh FROM (SELECT event_id, (value - 50) / 25 AS x FROM events)""",
)
def erf_gelu(spark, sf_dir):
    x = (F.col("value") - 50) / 25
    return _t(spark, sf_dir, "events").select("event_id", scalar.erf(x).alias("erf"), F.round(scalar.erfc(x), 9).alias("erfc"), scalar.gelu(x).alias("gelu"), scalar.gelu_tanh(x).alias("gelu_tanh"))


@query(
    "traced_expression",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN l_extendedprice * (1 - l_discount) ELSE l_discount * l_discount END AS y,
       CASE WHEN l_quantity > 25 THEN -l_extendedprice ELSE 2 * l_discount END AS slope FROM lineitem""",
)
def traced_expression(spark, sf_dir):
    names = ["l_extendedprice", "l_discount", "l_quantity"]
    made = traced.parsed("piecewise(q > 25, p * (1 - d), d ^ 2)", {"p": F.col(names[0]), "d": F.col(names[1]), "q": F.col(names[2])})
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", made.value.alias("y"), made.slopes[1].alias("slope"))


@query("unit_conversion", "SELECT p_partkey, p_size * 0.0254::DOUBLE AS size_m, p_retailprice * 0.45359237::DOUBLE / 0.001::DOUBLE AS mass_g FROM part")
def unit_conversion(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size_m"), F.col("p_retailprice").alias("mass_g"))
    p = units.to_unit(units.with_unit(p, "size_m", "in"), "size_m", "m")
    return units.to_unit(units.with_unit(p, "mass_g", "lb"), "mass_g", "g")


# --- joins, grouping, sorting ---

# keys that are null make rows without a match on either side
ORDERS = "(SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS key, o_totalprice AS amount FROM orders)"
CUSTOMERS = "(SELECT CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS key, c_name, c_acctbal AS amount FROM customer)"


def _join(how):
    def run(spark, sf_dir):
        orders = _t(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).alias("key"), F.col("o_totalprice").alias("amount"))
        customers = _t(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")).alias("key"), "c_name", F.col("c_acctbal").alias("amount"))
        return Frame(orders).join(Frame(customers), "key", how).df

    return run


for _how, _sql in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("outer", "FULL JOIN")):
    query(f"join_{_how}", f"SELECT o.o_orderkey, coalesce(o.key, c.key) AS key, o.amount, c.c_name, c.amount AS amount_right FROM {ORDERS} o {_sql} {CUSTOMERS} c ON o.key = c.key")(_join(_how))


@query(
    "join_null_keys",
    """SELECT count(*) AS n, count(c_name) AS matched FROM (SELECT CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey END AS key FROM orders) o
       FULL JOIN (SELECT CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey END AS key, c_name FROM customer) c ON o.key = c.key""",
)
def join_null_keys(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")).alias("key"))
    c = _t(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey")).alias("key"), "c_name")
    return Frame(o).join(Frame(c), "key", "outer").group_by().aggregate({"n": fn.count(), "matched": fn.count(col("c_name"))}).df


@query("join_mixed_types", "SELECT c.c_custkey AS key, c_name, o_totalprice FROM customer c JOIN (SELECT o_custkey::DOUBLE AS k, o_totalprice FROM orders) o ON c.c_custkey = o.k")
def join_mixed_types(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_name")
    return Frame(c).join(Frame(_t(spark, sf_dir, "orders").select(F.col("o_custkey").cast("double").alias("key"), "o_totalprice")), "key").df


@query(
    "group_aggregates",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, count(CASE WHEN l_linenumber > 3 THEN l_tax END) AS taxed, coalesce(sum(l_extendedprice * 2), 0) AS doubled,
       sum(l_orderkey)::BIGINT AS keys, avg(l_discount) AS mean_discount, stddev_samp(l_tax) AS sd_tax FROM lineitem GROUP BY 1, 2""",
)
def group_aggregates(spark, sf_dir):
    li = Frame(_t(spark, sf_dir, "lineitem").withColumn("late_tax", F.when(F.col("l_linenumber") > 3, F.col("l_tax"))))
    spec = {"n": fn.count(), "taxed": fn.count(col("late_tax")), "doubled": fn.sum(col("l_extendedprice") * 2), "keys": fn.sum(col("l_orderkey")), "mean_discount": fn.mean(col("l_discount")), "sd_tax": fn.stddev(col("l_tax"))}
    return li.group_by("l_returnflag", "l_linestatus").aggregate(spec).df


@query("top_parts", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 20")
def top_parts(spark, sf_dir):
    return _frame(spark, sf_dir, "part", "p_partkey").sort_by(desc("p_retailprice")).limit(20).select("p_partkey", "p_retailprice").df


@query("sorted_slice", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def sorted_slice(spark, sf_dir):
    return _frame(spark, sf_dir, "orders", "o_orderkey").sort_by("o_orderpriority", desc("o_totalprice")).slice(100, 150).select("o_orderkey", "o_totalprice").df


@query("concat_ranges", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '1994-01-01' UNION ALL SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'")
def concat_ranges(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return concat([Frame(o.where("o_orderdate < TIMESTAMP_NTZ '1994-01-01'")), Frame(o.where("o_orderdate >= TIMESTAMP_NTZ '1997-01-01'"))]).df


@query("value_counts", "SELECT c_mktsegment AS value, count(*) AS count FROM customer GROUP BY 1")
def value_counts(spark, sf_dir):
    return _frame(spark, sf_dir, "customer", "c_custkey").get_series("c_mktsegment").value_counts()


@query("unique_first_seen", "SELECT event_type, min(event_id) AS first FROM events GROUP BY 1")
def unique_first_seen(spark, sf_dir):
    return _frame(spark, sf_dir, "events", "event_id").get_series("event_type").unique()


@query("parquet_filter", "SELECT p_partkey, p_brand, p_size FROM part WHERE p_size > 10 AND p_size <= 40 AND (p_brand IN ('Brand#11', 'Brand#12') OR NOT (p_retailprice < 1500))")
def parquet_filter(spark, sf_dir):
    spec = {"p_size": {"$gt": 10, "$lte": 40}, "$or": [{"p_brand": {"$in": ["Brand#11", "Brand#12"]}}, {"$not": {"p_retailprice": {"$lt": 1500}}}]}
    return parquet.read_parquet(spark, f"{sf_dir}/part.parquet", ["p_partkey", "p_brand", "p_size"], spec)


@query("csv_lines", "SELECT concat_ws(',', o_orderkey, o_custkey, o_orderstatus, regexp_replace(o_totalprice::VARCHAR, '\\.0$', ''), strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ'), o_orderpriority) AS line FROM orders")
def csv_lines(spark, sf_dir):
    return _frame(spark, sf_dir, "orders").csv_lines()


@query(
    "json_rows",
    """SELECT '{"c_custkey":"' || c_custkey || '","c_name":"' || c_name || '","c_nationkey":' || c_nationkey || ',"c_acctbal":' || c_acctbal || ',"c_mktsegment":"' || c_mktsegment || '"}' AS json FROM customer""",
)
def json_rows(spark, sf_dir):
    return _frame(spark, sf_dir, "customer").json_rows()


@query("ordered_slice", "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 40 OFFSET 10")
def ordered_slice(spark, sf_dir):
    """A slice by the frame's own order, without a sort before."""
    e = _t(spark, sf_dir, "events").select((-F.col("event_id")).alias("back"), "event_id", "event_type").repartition(7, "event_type")
    return Frame(e, "back").slice(10, 60).limit(40).drop("back").df


# --- datasets ---


@query("dataset_chunks", "SELECT (event_id - (SELECT min(event_id) FROM events)) // 100 AS chunk, count(*) AS n, min(event_id) AS first, sum(value) AS total FROM events GROUP BY 1")
def dataset_chunks(spark, sf_dir):
    chunks = Dataset(_t(spark, sf_dir, "events").select("event_id", "value"), "event_id").chunk(100)
    return chunks.select("chunk", F.size("items").cast("long").alias("n"), F.col("items")[0]["event_id"].alias("first"), F.aggregate("items", F.lit(0.0), lambda s, x: s + x["value"]).alias("total"))


@query("dataset_batches", "SELECT r // 64 AS chunk, count(*)::INT AS n, min_by(value, r) AS head FROM (SELECT value, row_number() OVER (ORDER BY event_id) - 1 AS r FROM events) GROUP BY 1")
def dataset_batches(spark, sf_dir):
    made = Dataset(_t(spark, sf_dir, "events"), "event_id").batch(64, collate_scalars("value"))
    return made.select("chunk", F.size("batch").alias("n"), F.element_at("batch", 1).alias("head"))


@query("dataset_take_drop", "SELECT event_id FROM events ORDER BY event_id LIMIT 50 OFFSET 25")
def dataset_take_drop(spark, sf_dir):
    return Dataset(_t(spark, sf_dir, "events").select("event_id"), "event_id").drop(25).take(50).df


@query("dataset_epochs", "SELECT epoch, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events, (VALUES (0), (1), (2)) e(epoch) GROUP BY 1")
def dataset_epochs(spark, sf_dir):
    d = Dataset(_t(spark, sf_dir, "events").select("event_id"), "event_id").epochs(3, reshuffle_seed=7)
    return d.df.groupBy("epoch").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("dataset_shuffle", "SELECT event_id, md5('3:' || event_id) AS place, row_number() OVER (ORDER BY md5('3:' || event_id)) - 1 AS rank FROM events")
def dataset_shuffle(spark, sf_dir):
    d = Dataset(_t(spark, sf_dir, "events").select("event_id"), "event_id").shuffle(seed=3)
    return ranked(d.df, d.order).select("event_id", F.col(d.order)["h"].alias("place"), "rank")


@query(
    "dataset_shuffled_batches",
    """SELECT (r - 100) // 64 AS chunk, count(*)::INT AS n, list(event_id ORDER BY r) AS ids FROM
       (SELECT event_id, row_number() OVER (ORDER BY epoch, md5((7 + epoch) || ':' || event_id)) - 1 AS r FROM events, (VALUES (0), (1)) e(epoch)) WHERE r >= 100 GROUP BY 1""",
)
def dataset_shuffled_batches(spark, sf_dir):
    """Two reshuffled epochs without their first 100 rows, in batches."""
    d = Dataset(_t(spark, sf_dir, "events").select("event_id"), "event_id").epochs(2, reshuffle_seed=7).drop(100)
    made = d.batch(64, lambda items: F.transform(items, lambda x: x["event_id"]))
    return made.select("chunk", F.size("batch").alias("n"), F.col("batch").alias("ids"))


@query(
    "dataset_buffered_shuffle",
    "SELECT event_id, row_number() OVER (ORDER BY b, md5('5:' || event_id)) - 1 AS rank FROM (SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 500 AS b FROM events)",
)
def dataset_buffered_shuffle(spark, sf_dir):
    d = Dataset(_t(spark, sf_dir, "events").select("event_id"), "event_id").shuffle(seed=5, buffer_size=500)
    return ranked(d.df, d.order).select("event_id", "rank")


@query(
    "dataset_steps",
    """SELECT r // 50 AS chunk, list(value * 2 ORDER BY event_id) AS ys, list([event_id::DOUBLE, value] ORDER BY event_id) AS xs FROM
       (SELECT event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS r FROM events WHERE value > 20) GROUP BY 1""",
)
def dataset_steps(spark, sf_dir):
    """``map``, ``filter`` and the Python steps before batches of inputs and targets."""
    d = Dataset(_t(spark, sf_dir, "events").select("event_id", "value"), "event_id").filter(F.col("value") > 20)
    d = d.map({"x": F.array(F.col("event_id").cast("double"), F.col("value"))}).map_concurrent(_doubled, "event_id long, x array<double>, y double", 4)
    made = d.batch(50, collate_xy("x", "y")).join(d.batch(50, collate_vectors("x")).withColumnRenamed("batch", "matrix"), "chunk")
    return made.select("chunk", F.col("batch.y").alias("ys"), F.when(F.col("matrix") == F.col("batch.x"), F.col("matrix")).alias("xs"))


def _doubled(batches):
    for pdf in batches:
        yield pdf.assign(y=pdf["value"] * 2)[["event_id", "x", "y"]]


@query("event_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    return windowed_events(_t(spark, sf_dir, "events")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


# --- vectors and cells ---


@query(
    "vector_reductions",
    """SELECT vec_id, list_sum(e) AS total, list_avg(e) AS mean, list_var_pop(e) AS variance, list_min(e) AS low, list_max(e) AS high, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm,
       (list_position(e, list_max(e)) - 1)::INT AS top FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""",
)
def vector_reductions(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    v = F.col("e")
    return e.select("vec_id", V.total(v).alias("total"), V.mean(v).alias("mean"), V.variance(v).alias("variance"), V.extreme(v, False).alias("low"), V.extreme(v, True).alias("high"), V.norm(v).alias("norm"), V.arg_extreme(v, True).alias("top"))


@query(
    "vector_elementwise",
    """SELECT vec_id, list_sum(list_transform(e, lambda x: greatest(x, 0))) AS relu, list_sum(list_transform(e, lambda x: exp(x))) AS exps,
       list_dot_product(e, list_reverse(e)) AS mirror, list_sort(e)[1:3] AS least3 FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""",
)
def vector_elementwise(spark, sf_dir):
    v = F.col("embedding").cast("array<double>")
    least3 = F.transform(V.top_k(v, 3, largest=False), lambda t: t["value"])
    return _t(spark, sf_dir, "embeddings").select("vec_id", V.total(V.unary("relu", v)).alias("relu"), V.total(V.unary("exp", v)).alias("exps"), V.dot(v, F.reverse(v)).alias("mirror"), least3.alias("least3"))


@query("vector_softmax", "SELECT vec_id, list_max(p) AS top, list_sum(p) AS total FROM (SELECT vec_id, list_transform(e, lambda x: exp(x) / s) AS p FROM (SELECT vec_id, e, list_sum(list_transform(e, lambda x: exp(x))) AS s FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)))")
def vector_softmax(spark, sf_dir):
    p = V.softmax(F.col("embedding").cast("array<double>"))
    return _t(spark, sf_dir, "embeddings").select("vec_id", F.array_max(p).alias("top"), V.total(p).alias("total"))


@query(
    "cells_gram",
    "WITH c AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings) SELECT a.k::BIGINT AS i0, b.k::BIGINT AS i1, sum(a.v * b.v) AS v FROM c a JOIN c b USING (vec_id) GROUP BY 1, 2",
)
def cells_gram(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    n = e.select(F.size("embedding")).first()[0]
    return linalg.gram_of_vectors(e, "embedding", n).df


@query(
    "cells_reductions",
    "SELECT k::BIGINT AS i0, sum(v) AS total, stddev_pop(v) AS sd, max(v) AS high FROM (SELECT unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings) GROUP BY 1",
)
def cells_reductions(spark, sf_dir):
    cells = from_vectors(_t(spark, sf_dir, "embeddings"), "vec_id", "embedding", (0, 0))
    return cells.reduce_many({"total": "sum", "sd": "std", "high": "max"}, 0)


@query(
    "cells_centred",
    "SELECT i0, i1, v - avg(v) OVER (PARTITION BY i1) AS v FROM (SELECT vec_id AS i0, (generate_subscripts(embedding, 1) - 1)::BIGINT AS i1, unnest(embedding)::DOUBLE AS v FROM embeddings)",
)
def cells_centred(spark, sf_dir):
    cells = from_vectors(_t(spark, sf_dir, "embeddings"), "vec_id", "embedding", (1 << 40, 64))
    mean = cells.reduce("mean", 0)
    return cells.combine("sub", mean.unsqueeze(0)).df


@query("running_sum", "SELECT l_orderkey AS i0, l_linenumber::BIGINT AS i1, sum(q) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS v FROM (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)")
def running_sum(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("v"))
    return Cells(li.select(F.col("l_orderkey").alias("i0"), F.col("l_linenumber").cast("long").alias("i1"), "v"), (1 << 40, 8)).scan("cumsum", 1).df


# --- statistics, algebra, graphs, signals, training ---


@query(
    "statistics",
    "SELECT l_returnflag, count(l_quantity) AS count, avg(l_quantity) AS mean, stddev_pop(l_quantity) AS population_std, stddev_samp(l_quantity) AS sample_std, min(l_quantity) AS min, max(l_quantity) AS max, median(l_quantity) AS median FROM lineitem GROUP BY 1",
)
def statistics(spark, sf_dir):
    return stats.summary(_t(spark, sf_dir, "lineitem"), "l_quantity", "l_returnflag")


@query("percentiles", "SELECT l_linestatus, quantile_cont(l_extendedprice, 0.1) AS p10, quantile_cont(l_extendedprice, 0.95) AS p95, corr(l_quantity, l_extendedprice) AS r FROM lineitem GROUP BY 1")
def percentiles(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    found = stats.percentiles(li, "l_extendedprice", {"p10": 0.1, "p95": 0.95}, "l_linestatus")
    return found.join(li.groupBy("l_linestatus").agg(stats.correlation("l_quantity", "l_extendedprice").alias("r")), "l_linestatus")


@query("regression", "SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept, regr_r2(l_extendedprice, l_quantity) AS r2 FROM lineitem GROUP BY 1")
def regression(spark, sf_dir):
    return stats.linear_regression(_t(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag")


@query("least_squares", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem")
def least_squares(spark, sf_dir):
    w = linalg.least_squares(_t(spark, sf_dir, "lineitem").withColumn("one", F.lit(1.0)), ["l_quantity", "one"], "l_extendedprice")
    return spark.createDataFrame([(round(float(w[0]), 4), round(float(w[1]), 3))], "slope double, intercept double")


@query("small_matrices")
def small_matrices(spark, sf_dir):
    v = F.col("embedding").cast("array<double>")
    rows = F.sqrt(F.size(v)).cast("int")  # the whole vector as a square matrix
    return _t(spark, sf_dir, "embeddings").select("vec_id", *[linalg.each_matrix(n, v, rows).alias(n) for n in ("det", "inv", "rank", "singular_values")])


@query(
    "graph_adjacency",
    "SELECT src, count(*)::INT AS degree, list(dst ORDER BY dst) AS neighbours FROM (SELECT l_partkey AS src, l_suppkey AS dst FROM lineitem GROUP BY 1, 2) GROUP BY 1",
)
def graph_adjacency(spark, sf_dir):
    edges = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(F.sum("l_quantity").alias("weight"))
    return graph.adjacency(edges).select("src", "degree", "neighbours")


@query(
    "moving_windows",
    "SELECT event_type, segment, list_avg(x) AS mean FROM (SELECT event_type, s AS segment, list(value ORDER BY i) AS x FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i FROM events) e JOIN range(0, 1000000) r(s) ON s BETWEEN greatest(0, (i - 16) // 8 + CASE WHEN i < 16 THEN 0 ELSE 1 END) AND i // 8 AND i < s * 8 + 16 GROUP BY 1, 2 HAVING count(*) = 16)",
)
def moving_windows(spark, sf_dir):
    parts = signal.segments(_t(spark, sf_dir, "events"), "event_type", "event_id", "value", 16, 8)
    return parts.select("event_type", "segment", V.mean(F.col("x")).alias("mean"))


SEGMENTS = """x AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i FROM events),
       g AS (SELECT event_type, s, i - s * 16 AS k, value FROM x, (VALUES (0), (1)) d(d), LATERAL (SELECT i // 16 - d AS s) WHERE s >= 0),
       m AS (SELECT event_type, s, avg(value) AS mean FROM g GROUP BY 1, 2 HAVING count(*) = 32),
       w AS (SELECT g.event_type, g.s, k, (value - mean) * (0.5 - 0.5 * cos(2 * pi() * k / 32)) AS y FROM g JOIN m ON g.event_type = m.event_type AND g.s = m.s),
       f AS (SELECT event_type, s, bin, sum(y * cos(2 * pi() * bin * k / 32)) AS re, -sum(y * sin(2 * pi() * bin * k / 32)) AS im FROM w, (SELECT unnest(range(0, 17))::INT AS bin) GROUP BY 1, 2, 3)"""
#: Of the window 0.5 - 0.5 cos(2 pi k / 32): the sum of squares is 12, the sum 16.
DENSITY = "(CASE WHEN bin IN (0, 16) THEN 1 ELSE 2 END / 12.0::DOUBLE)"


@query("welch_power", f"WITH {SEGMENTS} SELECT event_type, bin, bin / 32.0::DOUBLE AS frequency, avg(re * re + im * im) * {DENSITY} AS power FROM f GROUP BY 1, 2")
def welch_power(spark, sf_dir):
    return signal.welch(_t(spark, sf_dir, "events"), "event_type", "event_id", "value", width=32)


@query("filtered_series")
def filtered_series(spark, sf_dir):
    series = signal.collected(_t(spark, sf_dir, "events"), "user_id", "event_id", "value")
    return series.select("user_id", F.size("x").alias("n"), signal.sos_filter(signal.butter(4, 0.2), F.col("x")).alias("low"), F.size(signal.find_peaks(F.col("x"))).alias("peaks"))


@query(
    "gradient_descent",
    """WITH RECURSIVE d AS (SELECT l_quantity / 50 AS q, l_extendedprice / 50000 AS y FROM lineitem),
       m AS (SELECT avg(q * q) AS qq, avg(q) AS q, avg(q * y) AS qy, avg(y) AS y FROM d),
       w(k, a, b, u, v) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE
         UNION ALL SELECT k + 1, a - 0.5 * nu, b - 0.5 * nv, nu, nv FROM (SELECT w.*, 0.5 * u + 2 * (a * qq + b * m.q - qy) AS nu, 0.5 * v + 2 * (a * m.q + b - m.y) AS nv FROM w, m WHERE k < 20))
       SELECT avg((d.q * a + b - d.y) * (d.q * a + b - d.y)) AS loss, count(*) AS rows FROM d, (SELECT a, b FROM w WHERE k = 20)""",
)
def gradient_descent(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 50).alias("q"), (F.col("l_extendedprice") / 50_000).alias("y"))
    w = training.fit(li, ["q"], "y", training.SGD(0.5, momentum=0.5), rounds=20)
    return li.select(training.mse(F.col("q") * float(w[0]) + float(w[1]), F.col("y")).alias("loss"), F.count("*").alias("rows"))
