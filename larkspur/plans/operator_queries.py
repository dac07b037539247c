"""Registered queries over series, units, losses, files, signals and graphs, and their SQL twins."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from ..functions import traced, units
from ..functions.expr import col
from ..operators import graph, layers, linalg, long_series, signal, stats, training
from ..operators.frame import Frame
from ..operators.ranges import running
from ..sources import binary, lazy, parquet, tensors, text
from ..sources.shared import shared_folder
from ..streaming import telemetry
from .registry import SEGMENTS, _frame, _t, query


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/larkspur-{uuid.uuid4().hex}"


# --- series and expressions ---


@query(
    "series_steps",
    """SELECT c_custkey, v IS NULL AS missing, coalesce(v, -1) AS filled, trunc(v)::INT AS whole, v::FLOAT AS single, v <> 0 AS truth, c_custkey::DOUBLE AS real
       FROM (SELECT c_custkey, CASE WHEN c_custkey % 6 <> 0 THEN c_acctbal END AS v FROM customer)""",
)
def series_steps(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 6 != 0, F.col("c_acctbal")).alias("v"))
    f = Frame(c, "c_custkey")
    v, key = f.get_series("v"), f.get_series("c_custkey")
    made = {"missing": v.is_null(), "filled": v.fill_null(-1.0), "whole": v.cast("int32"), "single": v.cast("float32"), "truth": v.cast("bool")}
    out = key.df.withColumn("real", F.col("c_custkey").cast("double"))
    for name, s in made.items():
        out = out.join(s.df.withColumnRenamed("v", name), "c_custkey")
    return out


@query(
    "series_values",
    "SELECT row_number() OVER (ORDER BY event_id) - 1 AS i0, value AS v, (SELECT value FROM events ORDER BY event_id OFFSET 3 LIMIT 1) AS third FROM events",
)
def series_values(spark, sf_dir):
    s = _frame(spark, sf_dir, "events", "event_id").get_series("value")
    return s.to_tensor().df.withColumn("third", F.lit(s.get(3)))


@query("series_dates", "SELECT event_id, date_trunc('millisecond', ts)::TIMESTAMP AS ts FROM events")
def series_dates(spark, sf_dir):
    s = _frame(spark, sf_dir, "events", "event_id").get_series("ts").to_dates()
    return s.df.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("frame_tensor", "SELECT o_orderkey, [o_custkey::DOUBLE, o_totalprice] AS \"values\" FROM orders WHERE o_totalprice <= 300000")
def frame_tensor(spark, sf_dir):
    f = _frame(spark, sf_dir, "orders", "o_orderkey").filter(col("o_totalprice").lte(300_000))
    return f.to_tensor(["o_custkey", "o_totalprice"])


@query(
    "pair_functions",
    """SELECT l_orderkey, l_linenumber, atan2(q, d + 1) AS angle, sqrt(q * q + d * d) AS length, least(q, d * 300) AS low, greatest(q, d * 300) AS high, q / sqrt(q * q + d * d) AS slope
       FROM (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_discount AS d FROM lineitem)""",
)
def pair_functions(spark, sf_dir):
    columns = {"q": F.col("l_quantity"), "d": F.col("l_discount")}
    made = {"angle": "atan2(q, d + 1)", "length": "hypot(q, d)", "low": "min(q, d * 300)", "high": "max(q, d * 300)"}
    out = {n: traced.parsed(t, columns) for n, t in made.items()}
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[t.value.alias(n) for n, t in out.items()], out["length"].slopes[0].alias("slope"))


@query("compiled_function", "SELECT event_id, exp(-x) * sin(x) + sqrt(x + 1) AS y, exp(-x) * (cos(x) - sin(x)) + 0.5 / sqrt(x + 1) AS slope FROM (SELECT event_id, abs(value) / 50 AS x FROM events)")
def compiled_function(spark, sf_dir):
    f = lambda x: traced.apply("exp", -x) * traced.apply("sin", x) + traced.apply("sqrt", x + 1)
    made = traced.compiled(f, [F.abs("value") / 50])
    return _t(spark, sf_dir, "events").select("event_id", made.value.alias("y"), made.slopes[0].alias("slope"))


@query(
    "unit_arithmetic",
    """SELECT p_partkey, s + s * 3 * 0.9144::DOUBLE / 0.3048::DOUBLE AS sum_ft, s - s * 0.0254::DOUBLE / 0.3048::DOUBLE AS less_ft, s * w AS area, s / w AS ratio, w * 0.028349523125::DOUBLE / 0.45359237::DOUBLE AS lb, s * 1000::DOUBLE / 3600 AS speed
       FROM (SELECT p_partkey, p_size::DOUBLE AS s, p_retailprice AS w FROM part)""",
)
def unit_arithmetic(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("s"), F.col("p_retailprice").alias("w"))
    p = p.withColumns({"yards": F.col("s") * 3, "inches": F.col("s"), "lb": F.col("w"), "speed": F.col("s")})
    for name, u in {"s": "ft", "w": "s", "yards": "yd", "inches": "in", "lb": "oz", "speed": "km/h"}.items():
        p = units.with_unit(p, name, u)
    p = units.add_columns(units.add_columns(p, "s", "yards", "sum_ft"), "s", "inches", "less_ft", -1)
    p = units.multiply_columns(units.multiply_columns(p, "s", "w", "area"), "s", "w", "ratio", -1)
    return units.to_unit(units.to_unit(p, "lb", "lb"), "speed", "m/s").select("p_partkey", "sum_ft", "less_ft", "area", "ratio", "lb", "speed")


# --- losses and distributions ---


@query(
    "losses",
    """SELECT label AS class, avg((p - t) * (p - t)) AS mse, avg(CASE WHEN abs(p - t) <= 0.1 THEN 0.5 * (p - t) * (p - t) ELSE 0.1 * (abs(p - t) - 0.05) END) AS huber,
       avg(greatest(p, 0) - p * (t > 0)::INT + ln(1 + exp(-abs(p)))) AS bce, avg(ln(list_sum(list_transform(e, lambda x: exp(x)))) - e[4]) AS ce
       FROM (SELECT label, embedding[1]::DOUBLE AS p, embedding[2]::DOUBLE AS t, embedding::DOUBLE[] AS e FROM embeddings) GROUP BY 1""",
)
def losses(spark, sf_dir):
    e = F.col("embedding").cast("array<double>")
    rows = _t(spark, sf_dir, "embeddings").select(F.col("label").alias("class"), e.alias("e"), F.get(e, 0).alias("p"), F.get(e, 1).alias("t"))
    p, t = F.col("p"), F.col("t")
    return rows.groupBy("class").agg(
        training.mse(p, t).alias("mse"), training.huber(p, t, 0.1).alias("huber"), training.binary_cross_entropy(p, (t > 0).cast("double")).alias("bce"), training.cross_entropy(F.col("e"), F.lit(3)).alias("ce")
    )


@query(
    "distributions",
    """SELECT event_id, exp(-((value - 50) / 10) * ((value - 50) / 10) / 2) / (10 * sqrt(2 * pi())) AS density, exp(k * ln(4.5) - 4.5 - lgamma(k + 1)) AS mass
       FROM (SELECT event_id, value, event_id % 12 AS k FROM events)""",
)
def distributions(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", stats.normal_density(F.col("value"), 50.0, 10.0).alias("density"), stats.poisson_mass(F.col("event_id") % 12, 4.5).alias("mass"))


@query(
    "difference_in_means",
    """WITH a AS (SELECT avg(value) FILTER (event_type = 'click') AS m1, avg(value) FILTER (event_type = 'view') AS m2, var_samp(value) FILTER (event_type = 'click') / count(*) FILTER (event_type = 'click') AS r1,
       var_samp(value) FILTER (event_type = 'view') / count(*) FILTER (event_type = 'view') AS r2, count(*) FILTER (event_type = 'click') AS n1, count(*) FILTER (event_type = 'view') AS n2 FROM events)
       SELECT (m1 - m2) / sqrt(r1 + r2) AS t, (r1 + r2) * (r1 + r2) / (r1 * r1 / (n1 - 1) + r2 * r2 / (n2 - 1)) AS df FROM a""",
)
def difference_in_means(spark, sf_dir):
    return stats.welch_t(_t(spark, sf_dir, "events"), "value", "event_type", "click", "view")


@query(
    "fitted_models",
    """WITH RECURSIVE d AS (SELECT l_quantity / 50 AS q, l_extendedprice / 50000 AS y FROM lineitem), m AS (SELECT avg(q * q) AS qq, avg(q) AS q, avg(q * y) AS qy, avg(y) AS y FROM d),
       w(k, a, b, s, t) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL
         SELECT k + 1, a - r * g / (sqrt(ns) + 1e-8), b - r * h / (sqrt(nt) + 1e-8), ns, nt FROM
         (SELECT *, CASE WHEN k = 0 THEN 0.01 * g * g ELSE 0.99 * s + 0.01 * g * g END AS ns, CASE WHEN k = 0 THEN 0.01 * h * h ELSE 0.99 * t + 0.01 * h * h END AS nt FROM
         (SELECT w.*, 2 * (a * qq + b * m.q - qy) AS g, 2 * (a * m.q + b - m.y) AS h, 0.01 * pow(0.1, k // 4) AS r FROM w, m WHERE k < 8))),
       z(k, a, b, m1, m2, v1, v2) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL
         SELECT k + 1, a * 0.99 - 0.1 * n1 / (1 - pow(0.9, k + 1)) / (sqrt(u1 / (1 - pow(0.999, k + 1))) + 1e-8), b * 0.99 - 0.1 * n2 / (1 - pow(0.9, k + 1)) / (sqrt(u2 / (1 - pow(0.999, k + 1))) + 1e-8), n1, n2, u1, u2 FROM
         (SELECT *, 0.9 * m1 + 0.1 * g AS n1, 0.9 * m2 + 0.1 * h AS n2, 0.999 * v1 + 0.001 * g * g AS u1, 0.999 * v2 + 0.001 * h * h AS u2 FROM
         (SELECT z.*, 2 * (a * qq + b * m.q - qy) AS g, 2 * (a * m.q + b - m.y) AS h FROM z, m WHERE k < 8)))
       SELECT 'rmsprop' AS optimizer, a AS slope, b AS intercept FROM w WHERE k = 8 UNION ALL SELECT 'adamw', a, b FROM z WHERE k = 8""",
)
def fitted_models(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 50).alias("q"), (F.col("l_extendedprice") / 50_000).alias("y"))
    found = {
        "rmsprop": training.fit(li, ["q"], "y", training.RMSprop(0.01), rounds=8, schedule=training.step_decay(4)),
        "adamw": training.fit(li, ["q"], "y", training.Adam(0.1, decay=0.1), rounds=8),
    }
    return spark.createDataFrame([(n, float(w[0]), float(w[1])) for n, w in found.items()], "optimizer string, slope double, intercept double")


# --- files ---


@query("parquet_round_trip", "SELECT o_orderkey, o_orderpriority, o_orderdate FROM orders WHERE o_totalprice > 250000")
def parquet_round_trip(spark, sf_dir):
    folder = _folder(spark)
    parquet.write_parquet(_t(spark, sf_dir, "orders"), folder, compression="zstd")
    return parquet.read_parquet(spark, folder, ["o_orderkey", "o_orderpriority", "o_orderdate"], {"o_totalprice": {"$gt": 250_000}})


@query(
    "ipc_round_trip",
    """SELECT event_id, ts, CASE WHEN event_id % 5 = 0 THEN 'null' WHEN event_id % 7 = 0 THEN 'nan' ELSE 'number' END AS kind, CASE WHEN event_id % 5 <> 0 AND event_id % 7 <> 0 THEN value END AS value FROM events""",
)
def ipc_round_trip(spark, sf_dir):
    """Rows as Arrow streams and back: what is null and what is NaN stay apart."""
    value = F.when(F.col("event_id") % 5 == 0, F.lit(None)).when(F.col("event_id") % 7 == 0, float("nan")).otherwise(F.col("value"))
    rows = _t(spark, sf_dir, "events").select("event_id", "ts", value.cast("double").alias("value"))
    folder = _folder(spark)
    binary.ipc_rows(rows).write.parquet(folder)
    back = binary.from_ipc_rows(spark.read.parquet(folder), rows.schema)
    kind = F.when(F.col("value").isNull(), "null").when(F.isnan("value"), "nan").otherwise("number")
    return back.select("event_id", "ts", kind.alias("kind"), F.when(~F.isnan("value"), F.col("value")).alias("value"))


@query("nested_files", "SELECT l_orderkey, l_linenumber, l_quantity AS first, l_tax AS last, 3 AS size, l_shipdate AS shipped, l_linestatus AS status FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_quantity >= 10")
def nested_files(spark, sf_dir):
    """Lists and structs written as Parquet, a folder a flag, and two of the folders read by a glob, with a filter on an entry of the struct."""
    folder = _folder(spark)
    rows = _t(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", F.array("l_quantity", "l_discount", "l_tax").alias("amounts"), F.struct("l_quantity", F.col("l_shipdate").alias("shipped"), F.col("l_linestatus").alias("status")).alias("state")
    )
    rows.write.partitionBy("l_returnflag").parquet(folder)
    back = parquet.read_parquet(spark, f"{folder}/l_returnflag=[AR]", ["l_orderkey", "l_linenumber", "amounts", "state"], {"state.l_quantity": {"$gte": 10}})
    return back.select("l_orderkey", "l_linenumber", F.get("amounts", 0).alias("first"), F.get("amounts", F.size("amounts") - 1).alias("last"), F.size("amounts").alias("size"), "state.shipped", "state.status")


@query(
    "unit_powers",
    "SELECT p_partkey, p_size * 1e4 AS cm2, p_size / 1e9 AS km3, p_size / 1e6 AS per_mm2, p_size * 1e3 AS newton_grams FROM part",
)
def unit_powers(spark, sf_dir):
    size = F.col("p_size").cast("double")
    pairs = {"cm2": (units.unit("m") ** 2, units.unit("cm") ** 2), "km3": (units.unit("m") ** 3, units.unit("km") ** 3), "per_mm2": (units.unit("m") ** -2, units.unit("mm") ** -2), "newton_grams": (units.unit("N"), units.unit("g*m/s^2"))}
    return _t(spark, sf_dir, "part").select("p_partkey", *[units.converted(size, a, b).alias(n) for n, (a, b) in pairs.items()])


@query("csv_round_trip", "SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment || ', \"' || c_nationkey || '\"' END AS note FROM customer")
def csv_round_trip(spark, sf_dir):
    note = F.when(F.col("c_custkey") % 5 != 0, F.concat("c_mktsegment", F.lit(', "'), F.col("c_nationkey").cast("string"), F.lit('"')))
    folder = _folder(spark)
    text.write_csv(Frame(_t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", note.alias("note"))), folder)
    return text.read_csv(spark, folder)


@query("array_files", "SELECT vec_id, 'float64' AS dtype, [8, 8]::BIGINT[] AS shape, embedding::DOUBLE[] AS \"values\" FROM embeddings")
def array_files(spark, sf_dir):
    """Vectors written as .npy bytes in Parquet, and read back by the reader of such files."""
    folder = _folder(spark)
    e = _t(spark, sf_dir, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    e.select("vec_id", binary.npy_column(F.col("v"), F.array(F.lit(8), F.lit(8))).alias("content")).write.parquet(folder)
    stored = spark.read.parquet(folder).select(F.col("vec_id").cast("string").alias("path"), "content")
    return binary.npy_rows(stored).select(F.col("path").cast("long").alias("vec_id"), "dtype", "shape", "values")


@query("lazy_source", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000")
def lazy_source(spark, sf_dir):
    """A table read part by part by a function of the user that is asked for two columns of the file."""
    o = _t(spark, sf_dir, "orders")
    low, high = o.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    folder = _folder(spark)
    part = F.floor((F.col("o_orderkey") - low) * 4 / (high - low + 1)).cast("int")
    o.withColumn("part", part).repartition("part").write.partitionBy("part").parquet(folder)
    files = [r["file"] for r in spark.read.parquet(folder).select(F.input_file_name().alias("file")).distinct().collect()]
    table = lazy.from_lazy_source(spark, f"orders_{uuid.uuid4().hex}", o.schema, files, _read_orders, ["o_totalprice", "o_orderkey"], filtered=True)
    return table.where("o_totalprice > 400000")


def _read_orders(file: str, wanted: list[str], tests: list[tuple[str, str, object]]):
    """Arrow batches of a file in any store, without the row groups that the pushed comparisons rule out."""
    from urllib.parse import unquote

    import pyarrow.dataset as ds

    store, path = tensors.located(unquote(file))
    keep = None
    for name, operator, value in tests:
        test = {"=": ds.field(name) == value, ">": ds.field(name) > value, ">=": ds.field(name) >= value, "<": ds.field(name) < value, "<=": ds.field(name) <= value}.get(operator)
        if test is not None:
            keep = test if keep is None else keep & test
    yield from ds.dataset(path, filesystem=store, format="parquet").to_batches(columns=wanted, filter=keep)


# --- signals ---

@query(
    "cross_spectra",
    """WITH x AS (SELECT event_type, value AS p, value * value / 100 + event_id % 7 AS q, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i FROM events),
       g AS (SELECT event_type, i // 16 - d AS s, i - (i // 16 - d) * 16 AS k, p, q FROM x, (VALUES (0), (1)) d(d) WHERE i // 16 - d >= 0),
       m AS (SELECT event_type, s, avg(p) AS mp, avg(q) AS mq FROM g GROUP BY 1, 2 HAVING count(*) = 32),
       f AS (SELECT g.event_type, g.s, bin, sum((p - mp) * h * cos(2 * pi() * bin * k / 32)) AS a, -sum((p - mp) * h * sin(2 * pi() * bin * k / 32)) AS b,
             sum((q - mq) * h * cos(2 * pi() * bin * k / 32)) AS c, -sum((q - mq) * h * sin(2 * pi() * bin * k / 32)) AS d
             FROM (SELECT *, 0.5 - 0.5 * cos(2 * pi() * k / 32) AS h FROM g) g JOIN m ON g.event_type = m.event_type AND g.s = m.s, (SELECT unnest(range(0, 17))::INT AS bin) GROUP BY 1, 2, 3),
       r AS (SELECT event_type, bin, avg(a * c + b * d) AS re, avg(a * d - b * c) AS im, avg(a * a + b * b) AS xx, avg(c * c + d * d) AS yy, CASE WHEN bin IN (0, 16) THEN 1 ELSE 2 END / 12.0::DOUBLE AS scale FROM f GROUP BY 1, 2)
       SELECT event_type, bin, bin / 32.0::DOUBLE AS frequency, round(re * scale, 4) + 0 AS cross_re, round(im * scale, 4) + 0 AS cross_im, round((re * re + im * im) / (xx * yy), 6) AS coherence FROM r WHERE bin > 0""",
)
def cross_spectra(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_type", "event_id", F.col("value").alias("p"), (F.col("value") * F.col("value") / 100 + F.col("event_id") % 7).alias("q"))
    made = signal.coherence(e, "event_type", "event_id", "p", "q", width=32).where("bin > 0")
    return made.select("event_type", "bin", "frequency", *[(F.round(c, k) + 0.0).alias(c) for c, k in (("cross_re", 4), ("cross_im", 4), ("coherence", 6))])


@query(
    "power_spectrogram",
    f"""WITH {SEGMENTS} SELECT event_type, s AS segment, (s * 16 + 16)::DOUBLE AS time_s, bin, round((re * re + im * im) * CASE WHEN bin IN (0, 16) THEN 1 ELSE 2 END / 12.0::DOUBLE, 6) + 0 AS psd, round(sqrt(re * re + im * im) / 16, 6) + 0 AS magnitude FROM f""",
)
def power_spectrogram(spark, sf_dir):
    """A row a stretch and bin, of both kinds of values."""
    e = _t(spark, sf_dir, "events")
    psd, magnitude = (signal.spectrogram(e, "event_type", "event_id", "value", width=32, overlap=16, window="hann", mode=m) for m in ("psd", "magnitude"))
    both = psd.join(magnitude.withColumnRenamed("values", "m"), ["event_type", "segment", "time_s"])
    bins = both.select("event_type", "segment", "time_s", F.posexplode(F.arrays_zip(F.col("values").alias("p"), "m")).alias("bin", "v"))
    return bins.select("event_type", "segment", "time_s", "bin", (F.round("v.p", 6) + 0.0).alias("psd"), (F.round("v.m", 6) + 0.0).alias("magnitude"))


@query(
    "median_power",
    f"""WITH {SEGMENTS}, p AS (SELECT event_type, bin, median(re * re + im * im) AS m, count(*) AS n FROM f GROUP BY 1, 2)
       SELECT event_type, bin, m / (1 + coalesce(list_sum(list_transform(range(1, (n - 1) // 2 + 1), lambda k: 1 / (2 * k + 1) - 1 / (2 * k))), 0)) * CASE WHEN bin IN (0, 16) THEN 1 ELSE 2 END / 12.0::DOUBLE AS power FROM p""",
)
def median_power(spark, sf_dir):
    return signal.welch(_t(spark, sf_dir, "events"), "event_type", "event_id", "value", width=32, average="median").drop("frequency")


@query(
    "windows_there_and_back",
    """SELECT event_type, i, x FROM (SELECT event_type, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
       WHERE i > 0 AND i < (n - 32) // 16 * 16 + 32""",
)
def windows_there_and_back(spark, sf_dir):
    """Short-time transforms and their inverse: the samples that the stretches cover (the first has no weight)."""
    spectra = signal.stft(_t(spark, sf_dir, "events"), "event_type", "event_id", "value", width=32)
    return signal.istft(spectra, "event_type", width=32).withColumn("x", F.round("x", 9))


@query(
    "unwrapped_phase",
    """SELECT user_id, event_id, a + coalesce(sum(j) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS a FROM
       (SELECT *, CASE WHEN abs(a - lag(a) OVER w) > pi() THEN -2 * pi() * round((a - lag(a) OVER w) / (2 * pi())) ELSE 0 END AS j FROM (SELECT user_id, event_id, value % 6.25 - 3 AS a FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id))""",
)
def unwrapped_phase(spark, sf_dir):
    return long_series.unwrap(_t(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") % 6.25 - 3).alias("a")), "user_id", "event_id", "a")


# --- graphs and running sums ---


@query("graph_offsets", "SELECT src, degree, (sum(degree) OVER (ORDER BY src) - degree)::BIGINT AS \"offset\" FROM (SELECT l_partkey AS src, count(DISTINCT l_suppkey)::INT AS degree FROM lineitem GROUP BY 1)")
def graph_offsets(spark, sf_dir):
    edges = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(F.sum("l_quantity").alias("weight"))
    return graph.with_offsets(graph.adjacency(edges).select("src", "degree"))


@query(
    "graph_dense",
    """WITH e AS (SELECT c_nationkey AS src, s_nationkey AS dst, count(*)::DOUBLE AS weight FROM customer JOIN supplier ON (c_custkey % 10) = (s_suppkey % 10) AND c_nationkey < s_nationkey GROUP BY 1, 2),
       m AS (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e)
       SELECT a.n_nationkey AS src, b.n_nationkey AS dst, coalesce(weight, CASE WHEN a.n_nationkey = b.n_nationkey THEN 0 ELSE -1 END) AS weight FROM nation a CROSS JOIN nation b LEFT JOIN m ON src = a.n_nationkey AND dst = b.n_nationkey""",
)
def graph_dense(spark, sf_dir):
    c, s = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "supplier")
    # counts by remainder before the join keep it small
    c = c.groupBy("c_nationkey", (F.col("c_custkey") % 10).alias("r")).agg(F.count("*").alias("n"))
    s = s.groupBy("s_nationkey", (F.col("s_suppkey") % 10).alias("r")).agg(F.count("*").alias("m"))
    edges = c.join(s, "r").where("c_nationkey < s_nationkey").groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.sum(F.col("n") * F.col("m")).cast("double").alias("weight"))
    return graph.dense(graph.mirrored(edges), _t(spark, sf_dir, "nation").select("n_nationkey"), missing=-1.0)


@query("running_totals", "SELECT o_orderkey, o_orderpriority, (sum(cents) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - cents)::BIGINT AS before FROM (SELECT *, round(o_totalprice * 100)::BIGINT AS cents FROM orders)")
def running_totals(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return running(o, "o_orderkey", "before", keys=["o_orderpriority"], amount="cents").drop("cents")


@query("checkpoint_files", "SELECT 'w' AS name, 'F64' AS dtype, unnest(range(0, 2)) AS at, round(unnest([regr_slope(l_extendedprice, l_quantity), regr_intercept(l_extendedprice, l_quantity)]), 4) AS weight FROM lineitem")
def checkpoint_files(spark, sf_dir):
    """Fitted weights written as a safetensors file in the shared folder and read back, a row a weight."""
    w = linalg.least_squares(_t(spark, sf_dir, "lineitem").withColumn("one", F.lit(1.0)), ["l_quantity", "one"], "l_extendedprice")
    path = f"{_folder(spark)}/weights.safetensors"
    tensors.write_tensors(path, {"step": np.zeros(1000), "w": np.asarray(w, float)}, {"kind": "regression"})
    read = tensors.read_many(spark, path, ["w"])
    return read.select("name", "dtype", "start", F.posexplode("values").alias("k", "v")).select("name", "dtype", (F.col("start") + F.col("k")).alias("at"), F.round("v", 4).alias("weight"))


@query("tensor_shards", "SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::BIGINT AS k, unnest(embedding)::DOUBLE AS v FROM embeddings")
def tensor_shards(spark, sf_dir):
    """All vectors as tensors in a file a task; ids and vectors are read back by their byte ranges, the norms beside them aren't."""
    e = _t(spark, sf_dir, "embeddings")
    folder = _folder(spark)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v * v))
    tensors.write_shards(e.select("vec_id", norm.alias("norm"), "embedding"), folder, {"vec_id": "I64", "norm": "F64", "embedding": "F32"})
    read = tensors.read_many(spark, folder, gap=4096, most=1 << 16)
    ids = tensors.rows_of(read.where(F.col("name").startswith("vec_id/")), 1).select("path", "number", "row", F.col("values").cast("long").alias("vec_id"))
    vectors = tensors.rows_of(read.where(F.col("name").startswith("embedding/")), 64)
    both = ids.join(vectors, ["path", "number", "row"])
    return both.select("vec_id", F.posexplode("values").alias("k", "v")).withColumn("k", F.col("k").cast("long"))


@query(
    "observed_orders",
    """WITH s AS (SELECT count(*)::DOUBLE AS n, min(o_totalprice) AS low, max(o_totalprice) AS high, avg(o_totalprice) AS mean, stddev_pop(o_totalprice) AS std FROM orders)
       SELECT 'rows' AS name, n AS value FROM s UNION ALL SELECT 'o_totalprice.min', low FROM s UNION ALL SELECT 'o_totalprice.max', high FROM s UNION ALL SELECT 'o_totalprice.mean', mean FROM s
       UNION ALL SELECT 'o_totalprice.std', std FROM s UNION ALL SELECT 'o_totalprice.finite', 1.0::DOUBLE""",
)
def observed_orders(spark, sf_dir):
    """Metrics that are gathered while the orders are written as a file."""
    run = telemetry.Run(spark)
    orders, pending = run.observe(_t(spark, sf_dir, "orders"), 1, {"rows": F.count("*"), **telemetry.summary("o_totalprice")})
    orders.write.parquet(_folder(spark))
    pending.emit()
    return run.events().where("kind = 'metric'").select("name", "value")


@query("layered_model")
def layered_model(spark, sf_dir):
    """Two layers fitted to all line items in mini-batches, a row a weight; a test holds such a fit against a plain loop."""
    li = _t(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("key"), (F.col("l_quantity") / 50).alias("q"), (F.col("l_discount") * 10).alias("d"), (F.col("l_extendedprice") / 50_000).alias("y")
    )
    model = layers.fit_layers(li, "key", ["q", "d"], ["y"], layers.Layers.drawn([2, 4, 1], ["tanh", "linear"], 1), training.Adam(0.05), batches=4, seed=2)
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(model.flat())], "place int, weight double")
