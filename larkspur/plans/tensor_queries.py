"""Registered queries over tensors (cells and vectors) and their SQL twins."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import complex_cells, image, linalg, training
from ..operators import vectors as V
from ..operators.coordinates import Cells, arange, concat, from_vectors, full, random_cells, random_integers, random_normal, stack, to_vectors
from .registry import SCALAR_SQL, SHIFTS, _t, erf_sql, query

CELLS = "c AS (SELECT vec_id AS i0, (generate_subscripts(embedding, 1) - 1)::BIGINT AS i1, unnest(embedding)::DOUBLE AS v FROM embeddings), size AS (SELECT count(*) AS n FROM embeddings)"


def _matrix(spark, sf_dir) -> Cells:
    e = _t(spark, sf_dir, "embeddings")
    return from_vectors(e, "vec_id", "embedding", (e.count(), 64))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _digest(op: str, cells: Cells) -> DataFrame:
    """How many cells there are, and sums that tell where they lie."""
    v, i, j = F.col("v"), F.col("i0"), F.col("i1")
    return cells.df.agg(F.lit(op).alias("op"), F.count("*").alias("n"), F.sum(v).alias("total"), F.sum(v * i).alias("rows"), F.sum(v * j).alias("columns"))


def _digests_sql(parts: dict[str, str], more: str = "") -> str:
    """``parts`` are selections of i0, i1 and v."""
    each = " UNION ALL ".join(f"SELECT '{op}' AS op, count(*) AS n, sum(v) AS total, sum(v * i0) AS rows, sum(v * i1) AS columns FROM ({sql})" for op, sql in parts.items())
    return f"WITH {CELLS}{more} {each}"


@query(
    "cells_moves",
    _digests_sql(
        {
            "permute": "SELECT i1 AS i0, i0 AS i1, v FROM c",
            "reshape": "SELECT (i0 * 64 + i1) // 2 AS i0, (i0 * 64 + i1) % 2 AS i1, v FROM c",
            "flatten": "SELECT i0 * 64 + i1 AS i0, 0 AS i1, v FROM c",
            "flip": "SELECT i0, 63 - i1 AS i1, v FROM c",
            "roll": "SELECT i0, (i1 + 5) % 64 AS i1, v FROM c",
            "slice": "SELECT i0, (i1 - 3) // 4 AS i1, v FROM c WHERE i1 BETWEEN 3 AND 59 AND (i1 - 3) % 4 = 0",
            "select": "SELECT 0 AS i0, i0 AS i1, v FROM c WHERE i1 = 7",
            "take": "SELECT i0, t AS i1, v FROM c JOIN (VALUES (5, 0), (0, 1), (5, 2), (63, 3)) w(i, t) ON i1 = i",
            "pad": "SELECT i0, i1 + 2 AS i1, v FROM c UNION ALL SELECT vec_id, p, 0.5 FROM embeddings, (VALUES (0), (1), (66), (67), (68)) b(p)",
            "repeat": "SELECT i0, i1 + 64 * r AS i1, v FROM c, (VALUES (0), (1), (2)) k(r)",
            "concat": "SELECT i0, i1, v FROM c UNION ALL SELECT i0 + n, 63 - i1, v FROM c, size",
            "stack": "SELECT i0, 63 - i1 AS i1, v FROM c",
            "squeeze": "SELECT i0, i1, v FROM c",
            "broadcast": "SELECT vec_id AS i0, i1, v FROM embeddings, (SELECT i1, avg(v) AS v FROM c GROUP BY 1)",
            "split": "SELECT i0, i1 - 16 AS i1, v FROM c WHERE i1 >= 16",
            "where": "SELECT a.i0, a.i1, CASE WHEN a.v > 0 THEN a.v ELSE b.v END AS v FROM c a JOIN c b ON a.i0 = b.i0 AND a.i1 = 63 - b.i1",
            "transpose": "SELECT i1 AS i0, i0 AS i1, v FROM c",
        }
    ),
)
def cells_moves(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    n = m.shape[0]
    made = {
        "permute": m.permute(1, 0), "reshape": m.reshape(-1, 2), "flatten": m.flatten().unsqueeze(1), "flip": m.flip(1), "roll": m.roll(5, 1), "slice": m.slice(1, 3, 60, 4),
        "select": m.select(1, 7).unsqueeze(0), "take": m.take([5, 0, 5, -1], 1), "pad": m.pad(1, 2, 3, 0.5), "repeat": m.repeat(3, 1), "concat": concat([m, m.flip(1)], 0),
        "stack": stack([m, m.flip(1)], 0).select(0, 1), "squeeze": m.unsqueeze(0).squeeze(0), "broadcast": m.reduce("mean", 0).broadcast_to(n, 64), "split": m.split([16, 48], 1)[1],
        "where": m.where(m.apply("relu"), m.flip(1)), "transpose": m.transpose(),
    }
    return _union([_digest(op, cells) for op, cells in made.items()])


MORE_SQL = {"neg": "-x", "log": "ln(x)", "gelu": f"0.5 * x * (1 + {erf_sql('x / sqrt(2)')})", "gelu_tanh": "0.5 * x * (1 + tanh(sqrt(2 / pi()) * (x + 0.044715 * x * x * x)))", "erf": erf_sql("x"), "erfc": f"1 - {erf_sql('x')}"}


@query(
    "cells_functions",
    f"WITH {CELLS}, b AS (SELECT abs(v) * 2 + 0.25 AS x FROM c), s AS (SELECT {', '.join(f'sum({sql}) AS f_{n}' for n, sql in (SCALAR_SQL | MORE_SQL).items())} FROM b) "
    + " UNION ALL ".join(f"SELECT '{n}' AS name, f_{n} AS total FROM s" for n in SCALAR_SQL | MORE_SQL),
)
def cells_functions(spark, sf_dir):
    base = _matrix(spark, sf_dir).apply("abs").combine("mul", 2.0).combine("add", 0.25)
    made = []
    for name in SCALAR_SQL | MORE_SQL:
        a, b = SHIFTS.get(name, (1, 0))
        made.append(base.combine("mul", a).combine("add", b).apply(name).reduce("sum").df.select(F.lit(name).alias("name"), F.col("v").alias("total")))
    return _union(made)


PAIRS = {"add": "x + y", "sub": "x - y", "mul": "x * y", "div": "x / y", "pow": "pow(x, y)", "atan2": "atan2(x, y)", "hypot": "sqrt(x * x + y * y)", "min": "least(x, y)", "max": "greatest(x, y)"}
TRUTHS = {"and": "x > 0.4 AND y > 0.4", "or": "x > 0.4 OR y > 0.4", "not": "NOT x > 0.4"}


@query(
    "cells_pairs",
    f"WITH {CELLS}, p AS (SELECT abs(a.v) + 0.25 AS x, abs(b.v) + 0.25 AS y FROM c a JOIN c b ON a.i0 = b.i0 AND a.i1 = 63 - b.i1) "
    + " UNION ALL ".join(f"SELECT '{n}' AS name, sum({sql})::DOUBLE AS total FROM p" for n, sql in PAIRS.items())
    + "".join(f" UNION ALL SELECT '{n}', count(*) FILTER ({sql})::DOUBLE FROM p" for n, sql in TRUTHS.items())
    + " UNION ALL SELECT 'int8', sum(trunc(x * 10))::DOUBLE FROM p UNION ALL SELECT 'float32', sum((x / 3)::FLOAT::DOUBLE) FROM p UNION ALL SELECT 'bool', count(*)::DOUBLE FROM p",
)
def cells_pairs(spark, sf_dir):
    x = _matrix(spark, sf_dir).apply("abs").combine("add", 0.25)
    y = x.flip(1)
    made = {n: x.combine(n, y) for n in PAIRS}
    a, b = (c.combine("sub", 0.4).apply("relu") for c in (x, y))
    made |= {"and": a.logical("and", b), "or": a.logical("or", b), "not": a.logical("not")}
    made |= {"int8": x.combine("mul", 10.0).cast("int8"), "float32": x.combine("div", 3.0).cast("float32"), "bool": x.cast("bool")}
    return _union([c.reduce("sum").df.select(F.lit(n).alias("name"), F.col("v").alias("total")) for n, c in made.items()])


@query(
    "cells_all_reductions",
    f"""WITH {CELLS} SELECT i0, sum(v) AS total, avg(v) AS mean, product(v + 1) AS prod, min(v) AS low, max(v) AS high, var_pop(v) AS variance, var_samp(v) AS sample_variance, stddev_pop(v) AS sd,
        bool_or(v > 0.3)::INT::DOUBLE AS some, bool_and(v < 0.3)::INT::DOUBLE AS every, arg_min(i1, v)::DOUBLE AS least_at, arg_max(i1, v)::DOUBLE AS most_at FROM c GROUP BY 1""",
)
def cells_all_reductions(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    hows = {"total": "sum", "mean": "mean", "low": "min", "high": "max", "variance": "variance", "sd": "std", "least_at": "argmin", "most_at": "argmax"}
    out = m.reduce_many(hows, 1).join(m.combine("add", 1.0).reduce("prod", 1).df.withColumnRenamed("v", "prod"), "i0")
    out = out.join(m.reduce("variance", 1, ddof=1).df.withColumnRenamed("v", "sample_variance"), "i0")
    above, below = m.combine("sub", 0.3).apply("relu"), m.apply("neg").combine("add", 0.3).apply("relu")
    return out.join(above.reduce("any", 1).df.withColumnRenamed("v", "some"), "i0").join(below.reduce("all", 1).df.withColumnRenamed("v", "every"), "i0")


@query(
    "cells_scans",
    _digests_sql(
        {
            "cumsum": "SELECT i0, i1, sum(v) OVER (PARTITION BY i0 ORDER BY i1) AS v FROM c",
            "cumprod": "SELECT i0, i1, product(v + 1) OVER (PARTITION BY i0 ORDER BY i1) AS v FROM c",
            "sort": "SELECT i0, row_number() OVER (PARTITION BY i0 ORDER BY v, i1) - 1 AS i1, v FROM c",
            "argsort": "SELECT i0, row_number() OVER (PARTITION BY i0 ORDER BY v, i1) - 1 AS i1, i1::DOUBLE AS v FROM c",
            "softmax": "SELECT i0, i1, exp(v) / sum(exp(v)) OVER (PARTITION BY i0) AS v FROM c",
            "top": "SELECT i0, k AS i1, v FROM (SELECT i0, v, row_number() OVER (PARTITION BY i0 ORDER BY v DESC, i1) AS k FROM c) WHERE k <= 3",
            "rows": "SELECT i0, i1, v FROM c",
            "mask": "SELECT i0 * 64 + i1 AS i0, 0 AS i1, v FROM c WHERE v > 0",
            "nonzero": "SELECT i0, i1, 1.0::DOUBLE AS v FROM c WHERE v > 0",
        }
    ),
)
def cells_scans(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    positive = m.apply("relu")
    rows = to_vectors(m).select(F.col("i0"), F.posexplode("values").alias("i1", "v"))
    made = {
        "cumsum": m.scan("cumsum", 1), "cumprod": m.combine("add", 1.0).scan("cumprod", 1), "sort": m.sort(1), "argsort": m.sort(1, indices=True), "softmax": m.softmax(1),
        "top": Cells(m.top_k(3, 1).select("i0", F.col("rank").alias("i1"), "v"), (0, 0)), "rows": Cells(rows, (0, 0)),
        "mask": Cells(m.mask(positive).select(F.col("place").alias("i0"), F.lit(0).alias("i1"), "v"), (0, 0)), "nonzero": Cells(positive.nonzero().withColumn("v", F.lit(1.0)), (0, 0)),
    }
    return _union([_digest(op, cells) for op, cells in made.items()])


def _drawn_sql(draw: int) -> str:
    return f"(('0x' || substr(md5('11:{draw}:' || f), 1, 13))::BIGINT / 4503599627370496.0)::DOUBLE"


@query(
    "cells_made",
    _digests_sql(
        {
            "uniform": f"SELECT f // 4 AS i0, f % 4 AS i1, {_drawn_sql(0)} * 5 - 2 AS v FROM places",
            "normal": f"SELECT f // 4 AS i0, f % 4 AS i1, sqrt(-2 * ln(1 - {_drawn_sql(1)})) * cos(2 * pi() * {_drawn_sql(2)}) * 3 + 1 AS v FROM places",
            "integers": f"SELECT f // 4 AS i0, f % 4 AS i1, floor({_drawn_sql(3)} * 9) - 4 AS v FROM places",
            "full": "SELECT f // 4 AS i0, f % 4 AS i1, 2.5::DOUBLE AS v FROM places",
            "arange": "SELECT f AS i0, 0 AS i1, 1.5 + f * 0.25::DOUBLE AS v FROM places",
        },
        ", places AS (SELECT unnest(range(0, 4 * n)) AS f FROM size)",
    ),
)
def cells_made(spark, sf_dir):
    n = _t(spark, sf_dir, "embeddings").count()
    made = {
        "uniform": random_cells(spark, (n, 4), 11, -2.0, 3.0), "normal": random_normal(spark, (n, 4), 11, 1.0, 3.0), "integers": random_integers(spark, (n, 4), 11, -4, 5),
        "full": full(spark, (n, 4), 2.5), "arange": arange(spark, 1.5, 1.5 + n, 0.25).unsqueeze(1),
    }
    return _union([_digest(op, cells) for op, cells in made.items()])


@query("frobenius_norm", f"WITH {CELLS} SELECT sqrt(sum(v * v)) AS norm FROM c")
def frobenius_norm(spark, sf_dir):
    return spark.createDataFrame([(_matrix(spark, sf_dir).frobenius(),)], "norm double")


@query(
    "one_long_line",
    _digests_sql(
        {
            "cumsum": "SELECT 0 AS i0, f AS i1, sum(v) OVER (ORDER BY f) AS v FROM l",
            "cumprod": "SELECT 0 AS i0, f AS i1, product(1 + v / 1000) OVER (ORDER BY f) AS v FROM l",
            "sort": "SELECT 0 AS i0, row_number() OVER (ORDER BY v, f) - 1 AS i1, v FROM l",
            "argsort": "SELECT 0 AS i0, row_number() OVER (ORDER BY v, f) - 1 AS i1, f::DOUBLE AS v FROM l",
            "softmax": "SELECT 0 AS i0, f AS i1, exp(v * 5) / sum(exp(v * 5)) OVER () AS v FROM l",
            "top": "SELECT k AS i0, f AS i1, v FROM (SELECT f, v, row_number() OVER (ORDER BY v DESC, f) AS k FROM l) WHERE k <= 7",
        },
        ", l AS (SELECT i0 * 64 + i1 AS f, v FROM c)",
    ),
)
def one_long_line(spark, sf_dir):
    """All cells as one line, in ranges and stretches of a thousand."""
    m = _matrix(spark, sf_dir)
    n = m.shape[0] * 64
    wide, flat = m.reshape(1, n), m.reshape(n)
    top = flat.top_k(7, 0, line=1000).select(F.col("rank").alias("i0"), F.col("i0").alias("i1"), "v")
    ahead = lambda c: Cells(c.df.select(F.lit(0).alias("i0"), F.col("i0").alias("i1"), "v"), (1, n))
    made = {
        "cumsum": wide.scan("cumsum", 1, line=1000), "cumprod": ahead(flat.combine("mul", 0.001).combine("add", 1.0).scan("cumprod", 0, line=1000)), "sort": wide.sort(1, line=1000),
        "argsort": ahead(flat.sort(0, indices=True, line=1000)), "softmax": ahead(flat.combine("mul", 5.0).softmax(0, line=1000)), "top": Cells(top, (7, n)),
    }
    return _union([_digest(op, cells) for op, cells in made.items()])


@query(
    "tall_triangle",
    """WITH g AS (SELECT sqrt(count(*)) AS a, sum(l_quantity) / sqrt(count(*)) AS b, sum(l_extendedprice) / sqrt(count(*)) AS c FROM lineitem),
       h AS (SELECT *, (SELECT regr_sxx(l_quantity, l_quantity) FROM lineitem) AS qq, (SELECT regr_sxy(l_extendedprice, l_quantity) FROM lineitem) AS qp, (SELECT regr_sxx(l_extendedprice, l_extendedprice) FROM lineitem) AS pp FROM g)
       SELECT * FROM (SELECT 0 AS i, 0 AS j, round(a, 6) AS r FROM h UNION ALL SELECT 0, 1, round(b, 5) FROM h UNION ALL SELECT 0, 2, round(c, 3) FROM h
       UNION ALL SELECT 1, 1, round(sqrt(qq), 5) FROM h UNION ALL SELECT 1, 2, round(qp / sqrt(qq), 3) FROM h UNION ALL SELECT 2, 2, round(sqrt(pp - qp * qp / qq), 3) FROM h)""",
)
def tall_triangle(spark, sf_dir):
    """R of all rows (1, quantity, price), a row an entry."""
    digits = [[6, 5, 3], [5, 5, 3], [3, 3, 3]]
    r = linalg.triangle(_t(spark, sf_dir, "lineitem").select(F.lit(1.0).alias("one"), "l_quantity", "l_extendedprice"), ["one", "l_quantity", "l_extendedprice"])
    rows = [(i, j, round(float(r[i, j]), digits[i][j])) for i in range(len(r)) for j in range(i, len(r))]
    return spark.createDataFrame(rows, "i int, j int, r double")


@query(
    "orthonormal_rows",
    """WITH m AS (SELECT avg(l_quantity) AS q, avg(l_extendedprice) AS p, regr_sxx(l_quantity, l_quantity) AS qq, regr_sxy(l_extendedprice, l_quantity) / regr_sxx(l_quantity, l_quantity) AS slope, count(*) AS n FROM lineitem),
       u AS (SELECT l_orderkey, l_linenumber, 1 / sqrt(n) AS a, (l_quantity - q) / sqrt(qq) AS b, (l_extendedprice - p) - slope * (l_quantity - q) AS c FROM lineitem, m)
       SELECT l_orderkey, l_linenumber, round(a, 9) AS a, round(b, 9) + 0 AS b, round(c / sqrt((SELECT sum(c * c) FROM u)), 9) + 0 AS c FROM u""",
)
def orthonormal_rows(spark, sf_dir):
    """Q of the same rows."""
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lit(1.0).alias("one"), "l_quantity", "l_extendedprice")
    made, _ = linalg.tall_qr(li, ["one", "l_quantity", "l_extendedprice"])
    return made.select("l_orderkey", "l_linenumber", *[(F.round(F.col("q")[k], 9) + 0.0).alias(c) for k, c in enumerate("abc")])


@query(
    "attention",
    f"""WITH {CELLS}, m AS (SELECT i0, i1 // 8 AS r, i1 % 8 AS k, v FROM c),
    s AS (SELECT a.i0, a.r, b.r AS j, sum(a.v * b.v) / sqrt(8) AS s FROM m a JOIN m b ON a.i0 = b.i0 AND a.k = b.k GROUP BY 1, 2, 3),
    p AS (SELECT i0, r, j, exp(s) / sum(exp(s)) OVER (PARTITION BY i0, r) AS p FROM s)
    SELECT p.i0, p.r AS i1, m.k AS i2, sum(p * v) AS v FROM p JOIN m ON p.i0 = m.i0 AND p.j = m.r GROUP BY 1, 2, 3""",
)
def attention(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    blocks = m.reshape(m.shape[0], 8, 8)
    return training.attention(blocks, blocks, blocks).df


VECTOR_SQL = {
    "eq": "len(list_filter(e, lambda x: x = r[1]))::INT", "ne": "len(list_filter(e, lambda x: x <> r[1]))::INT", "lt": "len(list_filter(e, lambda x: x < 0.1))::INT", "ge": "len(list_filter(e, lambda x: x >= 0.1))::INT",
    "chosen": "list_sum(list_transform(range(1, 65), lambda i: CASE WHEN e[i] > r[i] THEN e[i] ELSE r[i] END))", "clipped": "list_sum(list_transform(e, lambda x: greatest(-0.1, least(0.1, x))))",
    "some": "len(list_filter(e, lambda x: x <> 0)) > 0", "every": "len(list_filter(e, lambda x: x <> 0)) = 64",
    "cumsum": "list_sum(list_transform(range(1, 65), lambda i: (65 - i) * e[i]))", "cumprod": "list_product(list_transform(e, lambda x: x + 1))",
    "rolled": "list_sum(list_transform(range(1, 65), lambda i: e[(i + 60) % 64 + 1] * i))", "unfolded": "list_sum(list_transform(range(1, 62), lambda i: (e[i] + e[i + 1] + e[i + 2] + e[i + 3]) * i))",
    "padded": "list_sum(list_transform(range(1, 65), lambda i: e[i] * (i + 2))) + 0.5 * (1 + 2 + 67)", "taken": "e[1] + 2 * e[6] + 3 * e[64]", "sliced": "list_sum(list_transform(range(0, 16), lambda i: e[61 - 4 * i] * (i + 1)))",
    "normalized": "list_sum(list_transform(range(1, 65), lambda i: (e[i] - CASE WHEN i % 2 = 1 THEN 0.1 ELSE 0.2 END) / CASE WHEN i % 2 = 1 THEN 2 ELSE 4 END))",
    "convolved": "list_sum(list_transform(range(1, 65), lambda i: e[i] * (1 * i + 2 * (i + 1) + 3 * (i + 2))))", "correlated": "list_sum(list_transform(range(1, 65), lambda i: e[i] * (3 * i + 2 * (i + 1) + 1 * (i + 2))))",
    "sd": "list_stddev_samp(e)", "cosine": "list_dot_product(e, r) / list_dot_product(e, e)", "reversed": "list_dot_product(e, r)", "powers": "list_sum(list_transform(e, lambda x: pow(x, 3)))",
}


@query("vector_operations", f"SELECT vec_id, {', '.join(f'{sql} AS {n}' for n, sql in VECTOR_SQL.items())} FROM (SELECT vec_id, embedding::DOUBLE[] AS e, list_reverse(embedding::DOUBLE[]) AS r FROM embeddings)")
def vector_operations(spark, sf_dir):
    e, r = F.col("e"), F.reverse("e")
    true = lambda v: F.size(F.filter(v, lambda x: x))
    placed = lambda v: V.total(F.transform(v, lambda x, i: x * (i + 1)))
    kernel = F.array(*[F.lit(float(k)) for k in (1, 2, 3)])
    made = {
        "eq": true(V.compare("eq", e, F.array_repeat(F.get(r, 0), 64))), "ne": true(V.compare("ne", e, F.array_repeat(F.get(r, 0), 64))), "lt": true(V.compare("lt", e, 0.1)), "ge": true(V.compare("ge", e, 0.1)),
        "chosen": V.total(V.where(V.compare("gt", e, r), e, r)), "clipped": V.total(V.clip(e, -0.1, 0.1)), "some": V.any_(e), "every": V.all_(e), "cumsum": V.total(V.cumsum(e)),
        "cumprod": F.element_at(V.cumprod(V.binary("add", e, 1.0)), -1), "rolled": placed(V.roll(e, 3)), "unfolded": placed(F.transform(V.unfold(e, 4), V.total)), "padded": placed(V.pad(e, 2, 1, 0.5)),
        "taken": placed(V.take(e, [0, 5, -1])), "sliced": placed(V.slice_(e, 60, None, -4)), "normalized": V.total(V.normalize(e, [0.1, 0.2], [2.0, 4.0])), "convolved": placed(V.convolve(e, kernel)),
        "correlated": placed(V.correlate(e, kernel)), "sd": V.std(e, 1), "cosine": V.cosine(e, r), "reversed": V.dot(e, r), "powers": V.total(V.binary("pow", e, 3.0)),
    }
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return rows.select("vec_id", *[c.alias(n) for n, c in made.items()])


@query(
    "vector_order",
    "SELECT vec_id, (SELECT list(i - 1 ORDER BY x, i) FROM (SELECT unnest(e) AS x, generate_subscripts(e, 1) AS i))::INT[] AS places, list_sort(e) AS sorted FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)",
)
def vector_order(spark, sf_dir):
    e = F.col("embedding").cast("array<double>")
    places = V.argsort(e)
    return _t(spark, sf_dir, "embeddings").select("vec_id", places.alias("places"), F.transform(places, lambda i: F.get(e, i)).alias("sorted"))


LAYERS_SQL = """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, list_avg(embedding::DOUBLE[]) AS m, list_var_pop(embedding::DOUBLE[]) AS s FROM embeddings)
SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: e[i] * (i % 3 - 1))) + 0.5 AS linear, list_sum(list_transform(range(1, 65), lambda i: (e[i] - m) / sqrt(s + 1e-5) * i)) AS normed,
  list_sum(list_transform(range(1, 65), lambda i: e[i] * 0.5 * e[65 - i] * (1 + tanh(sqrt(2 / pi()) * (e[65 - i] + 0.044715 * pow(e[65 - i], 3)))))) AS gated,
  list_sum(list_transform(range(1, 65), lambda i: i * (e[i] * cos(vec_id * pow(10000.0, -2.0 * ((i - 1) % 32) / 64)) + CASE WHEN i <= 32 THEN -e[i + 32] ELSE e[i - 32] END * sin(vec_id * pow(10000.0, -2.0 * ((i - 1) % 32) / 64))))) AS turned,
  e[1] AS looked_up FROM e"""


@query("layers", LAYERS_SQL)
def layers(spark, sf_dir):
    e = F.col("e")
    placed = lambda v: V.total(F.transform(v, lambda x, i: x * (i + 1)))
    weight = np.array([[(i + 1) % 3 - 1.0 for i in range(64)]])
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    looked = training.embedding(rows.select("vec_id"), rows.select(F.col("vec_id").alias("id"), F.col("e").alias("vector")), "vec_id")
    made = {"linear": F.get(training.linear(e, weight, np.array([0.5])), 0), "normed": placed(training.layer_norm(e)), "gated": V.total(training.geglu(e, F.reverse(e))), "turned": placed(training.rotary(e, F.col("vec_id")))}
    return rows.select("vec_id", *[c.alias(n) for n, c in made.items()]).join(looked.select("vec_id", F.get("embedding", 0).alias("looked_up")), "vec_id")


def _drawn_sql(place: str) -> str:
    """A number in [0, 1) by the digest of seed 5, draw 0 and the place."""
    return f"(('0x' || substr(md5('5:0:' || {place}), 1, 13))::BIGINT / 4503599627370496.0)"


@query(
    "sequential_layers",
    f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
       h AS (SELECT vec_id, list_transform(range(0, 4), lambda k: greatest(0, list_sum(list_transform(range(0, 64), lambda i: e[i + 1] * cos(k * 64.0 + i))) + 0.25 * k)) AS h FROM e),
       d AS (SELECT vec_id, h, list_transform(range(0, 4), lambda k: CASE WHEN {_drawn_sql("vec_id || ':' || k")} >= 0.25 THEN h[k + 1] / 0.75 ELSE 0 END) AS d FROM h)
       SELECT vec_id, h[1] - h[2] + 2 * h[3] - h[4] AS whole, d[1] - d[2] + 2 * d[3] - d[4] AS thinned, len(list_filter(d, lambda x: x = 0)) AS zeros FROM d""",
)
def sequential_layers(spark, sf_dir):
    """A linear layer, its positive part, dropout (in training only), and a linear layer."""
    first, bias, last = np.cos(np.arange(256.0)).reshape(4, 64), 0.25 * np.arange(4), np.array([[1.0, -1.0, 2.0, -1.0]])
    hidden = [lambda x: training.linear(x, first, bias), lambda x: F.transform(x, lambda v: F.greatest(F.lit(0.0), v))]
    drop, out = lambda x: training.dropout(x, 0.25, 5, F.col("vec_id")), lambda x: F.get(training.linear(x, last), 0)
    e = F.col("embedding").cast("array<double>")
    zeros = lambda x: F.size(F.filter(x, lambda v: v == 0)).cast("long")
    made = {"whole": [*hidden, out], "thinned": [*hidden, drop, out], "zeros": [*hidden, drop, zeros]}
    return _t(spark, sf_dir, "embeddings").select("vec_id", *[training.sequential(*steps)(e).alias(n) for n, steps in made.items()])


@query(
    "sums_to_shape",
    _digests_sql(
        {
            "columns": "SELECT 0 AS i0, i1, sum(v) AS v FROM c GROUP BY i1",
            "rows": "SELECT i0, 0 AS i1, sum(v) AS v FROM c GROUP BY i0",
            "all": "SELECT 0 AS i0, 0 AS i1, sum(v) AS v FROM c",
            "leading": "SELECT i1 AS i0, 0 AS i1, sum(v) AS v FROM c GROUP BY i1",
            "same": "SELECT i0, i1, v FROM c",
        }
    ),
)
def sums_to_shape(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    n = m.shape[0]
    made = {"columns": m.sum_to_shape(1, 64), "rows": m.sum_to_shape(n, 1), "all": m.sum_to_shape(1, 1), "leading": m.sum_to_shape(64).unsqueeze(1), "same": m.sum_to_shape(n, 64)}
    return _union([_digest(op, cells) for op, cells in made.items()])


COMPLEX = f"WITH {CELLS}, z AS (SELECT a.i0, a.i1, a.v AS re, b.v AS im FROM c a JOIN c b ON a.i0 = b.i0 AND b.i1 = 63 - a.i1)"


def _complex(spark, sf_dir) -> complex_cells.ComplexCells:
    m = _matrix(spark, sf_dir)
    return complex_cells.from_parts(m, m.flip(1))


@query(
    "complex_arithmetic",
    f"""{COMPLEX}, w AS (SELECT i1, avg(re) AS a, avg(im) AS b FROM z GROUP BY 1),
       p AS (SELECT i0, re, im, re * a + im * b AS x, re * b - im * a AS y, re + 2 AS c, im - 1 AS d FROM z JOIN w ON z.i1 = w.i1),
       q AS (SELECT i0, re, im, (x * c + y * d) / (c * c + d * d) AS x, (y * c - x * d) / (c * c + d * d) AS y FROM p)
       SELECT i0, round(sum(x), 6) + 0 AS re, round(sum(y), 6) + 0 AS im, round(sum(sqrt(x * x + y * y)), 6) AS "size", round(sum(im) * 0.1, 6) + 0 AS angle, round(sum(exp(re * 0.1) * cos(im * 0.1)), 6) AS grown FROM q GROUP BY 1""",
)
def complex_arithmetic(spark, sf_dir):
    """conj(z) w / (z + 2 - i) with the mean w of each column, and exp(z / 10); sums by row."""
    z = _complex(spark, sf_dir)
    mean = z.reduce("mean", 0)
    w = complex_cells.ComplexCells(mean.df.select(F.lit(0).cast("long").alias("i0"), F.col("i0").alias("i1"), "re", "im"), (1, z.shape[1]))
    q = z.apply("conj").combine("mul", w).combine("div", z.combine("add", 2 - 1j))
    grown = z.combine("mul", 0.1).apply("exp")
    made = {"re": q.part("re"), "im": q.part("im"), "size": q.part("abs"), "angle": grown.part("arg"), "grown": grown.part("re")}
    sums = [cells.reduce("sum", 1).df.select("i0", (F.round("v", 6) + 0.0).alias(name)) for name, cells in made.items()]
    return reduce(lambda a, b: a.join(b, "i0"), sums)


@query(
    "complex_transform",
    f"""{COMPLEX} SELECT i0, (k + 32) % 64 AS i1, round(sum(re * cos(2 * pi() * ((k * i1) % 64) / 64) + im * sin(2 * pi() * ((k * i1) % 64) / 64)), 6) + 0 AS re,
       round(sum(im * cos(2 * pi() * ((k * i1) % 64) / 64) - re * sin(2 * pi() * ((k * i1) % 64) / 64)), 6) + 0 AS im FROM z, (SELECT unnest(range(0, 64)) AS k) GROUP BY i0, k""",
)
def complex_transform(spark, sf_dir):
    """Rows transformed, by four steps (lines of more than 16 numbers are long here), with the zero frequency in the middle."""
    made = _complex(spark, sf_dir).fft(1, group=16).shift([1])
    return made.df.select("i0", "i1", *[(F.round(c, 6) + 0.0).alias(c) for c in ("re", "im")])


@query(
    "image_resize",
    """SELECT vec_id, len(e) = 64 AS whole,
       list_sum(list_transform(range(0, 16), lambda k: e[(2 * (k // 4) + 1) * 8 + 2 * (k % 4) + 1 + 1] * (k + 1))) AS nearest,
       list_sum(list_transform(range(0, 16), lambda k: (k + 1) * (e[16 * (k // 4) + 2 * (k % 4) + 1] + e[16 * (k // 4) + 2 * (k % 4) + 2] + e[16 * (k // 4) + 8 + 2 * (k % 4) + 1] + e[16 * (k // 4) + 8 + 2 * (k % 4) + 2]) / 4)) AS bilinear
       FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""",
)
def image_resize(spark, sf_dir):
    e = F.col("embedding").cast("array<double>")
    placed = lambda v: V.total(F.transform(v, lambda x, i: x * (i + 1)))
    small = lambda how: placed(image.resize(e, (8, 8), (4, 4), 1, how))
    return _t(spark, sf_dir, "embeddings").select("vec_id", (F.size(e) == 64).alias("whole"), small("nearest").alias("nearest"), small("bilinear").alias("bilinear"))


assert set(SCALAR_SQL) <= set(scalar.UNARY) and set(MORE_SQL) <= {*scalar.UNARY, *scalar.MORE_UNARY}
