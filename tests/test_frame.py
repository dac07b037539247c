import math

import pytest
from pyspark.sql import functions as F

from larkspur.functions.expr import col, fn, int64, lit
from larkspur.operators.frame import Frame, concat, desc
from larkspur.sources import text
from larkspur.types import UnsupportedTypeError, check_strict


@pytest.fixture(scope="module")
def timber(spark):
    """A yard's stock, in order of place: lengths, pieces, names, and whether it is dry."""
    stock = [(10, 2.4, 60, "birch", False), (20, 0.0, 7, None, True), (30, None, None, "", None), (40, -1.25, 2, "oak", True), (50, 6.0, 41, "elm", False), (60, 3.6, -5, "ash", None)]
    return Frame(spark.createDataFrame(stock, "place int, length double, pieces int, name string, dry boolean").repartition(3, "name"), "place")


def rows(frame, *names):
    return [tuple(r[n] for n in names) for r in frame.df.collect()]


def test_select_drop_rename(timber):
    assert timber.select("name", "length").columns == ["name", "length"]
    assert timber.drop("pieces", "absent", "dry").columns == ["place", "length", "name"]
    assert timber.rename({"name": "wood", "absent": "z", "dry": ""}).columns == ["place", "length", "pieces", "wood", "dry"]
    assert timber.rename({"place": "at"}).order == "at" and timber.drop("place").order is None
    with pytest.raises(KeyError, match="weight"):
        timber.select("weight")
    with pytest.raises(ValueError):
        timber.rename({"length": "pieces"})


def test_null_rules(timber):
    by_place = lambda f, c: [r[0] for r in rows(f.sort_by("place"), c)]
    assert by_place(timber.drop_null(), "place") == [10, 40, 50] and by_place(timber.drop_null("name", "length"), "place") == [10, 40, 50, 60]
    assert by_place(timber.fill_null({"name": "any"}), "name") == ["birch", "any", "", "oak", "elm", "ash"]
    assert by_place(timber.fill_null(9), "pieces") == [60, 7, 9, 2, 41, -5]
    assert timber.null_count() == {"place": 0, "length": 1, "pieces": 1, "name": 1, "dry": 2}
    assert by_place(timber.filter(col("length").gt(0)), "place") == [10, 50, 60]
    # three-valued logic: null and false is false, null or true is true
    got = timber.with_columns({"both": col("dry").and_(lit(False)), "either": col("dry").or_(lit(True)), "kept": col("dry").and_(lit(True))})
    assert {r for r in rows(got.filter(col("place").eq(30)), "both", "either", "kept")} == {(False, True, None)}


def test_limit_and_slice_follow_the_order(timber):
    assert [r[0] for r in rows(timber.limit(3), "place")] == [10, 20, 30]
    assert [r[0] for r in rows(timber.slice(4), "place")] == [50, 60] and rows(timber.slice(2, 2), "place") == []
    assert [r[0] for r in rows(timber.limit(5).slice(1, 3), "place")] == [20, 30]
    assert [r[0] for r in rows(timber.sort_by(desc("pieces")).limit(2), "place")] == [10, 50]
    assert [r[0] for r in rows(timber.filter(col("pieces").lt(10)).slice(1, 3), "place")] == [40, 60]
    with pytest.raises(ValueError):
        timber.limit(-1)


def test_nan_and_division(spark):
    f = Frame(spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (float("nan"), 1.0)], "a double, b double"))
    got = rows(f.with_columns({"q": col("a").div(col("b")), "gt": col("a").gt(1), "eq": col("a").eq(col("a")), "ne": col("a").ne(col("a"))}), "q", "gt", "eq", "ne")
    assert got[0][0] == math.inf and got[1][0] == -math.inf and math.isnan(got[2][0])
    assert got[3][1:] == (False, False, True)
    with pytest.raises(TypeError):
        f.with_columns({"x": col("a").add(lit("text"))})


def test_whole_numbers_stay_whole(spark):
    f = Frame(spark.createDataFrame([(9007199254740993, 2), (-7, 2)], "a long, b long"))
    made = f.with_columns({"s": col("a") + col("b"), "q": col("a").div(col("b")), "h": col("a") + lit(0.5), "k": col("a") * int64(1)})
    assert rows(made, "s", "q") == [(9007199254740995, 4503599627370496), (-5, -3)]
    assert dict(made.df.dtypes)["h"] == "double" and dict(made.df.dtypes)["k"] == "bigint"


def test_round_and_friends(spark):
    f = Frame(spark.createDataFrame([(-2.5,), (2.5,), (0.49999999999999994,), (1e300,), (float("nan"),)], "x double"))
    got = [r[0] for r in rows(f.with_columns({"r": fn.round(col("x"))}), "r")]
    assert got[:4] == [-2.0, 3.0, 0.0, 1e300] and math.isnan(got[4])
    got = rows(f.with_columns({"l": fn.ln(col("x") * 0), "m": fn.ln(col("x") * 0 - 1)}).limit(1), "l", "m")[0]
    assert got[0] == -math.inf and math.isnan(got[1])


@pytest.mark.parametrize("name", ["sin", "cos", "tan", "exp", "sqrt", "asin", "acos", "atan", "sinh", "cosh", "tanh", "asinh", "cbrt", "expm1", "log1p", "erf", "log10", "log2", "atanh"])
def test_scalar_functions_agree_with_math(spark, name):
    f = Frame(spark.createDataFrame([(0.1,), (0.5,), (0.9,), (None,)], "x double"))
    got = [r[0] for r in rows(f.with_columns({"y": getattr(fn, name)(col("x"))}), "y")]
    assert got[3] is None and all(abs(g - getattr(math, name)(x)) < 1e-12 for g, x in zip(got, (0.1, 0.5, 0.9)))


def test_groups(spark):
    took = [("bus", 12.0), ("bus", 18.0), ("bus", 15.0), ("bus", None), ("tram", 9.5), ("walk", None), (None, 30.0), (None, 31.0)]
    f = Frame(spark.createDataFrame(took, "way string, minutes double"))
    spec = {"n": fn.count(), "timed": fn.count(col("minutes")), "sum": fn.sum(col("minutes")), "mean": fn.mean(col("minutes")), "sd": fn.stddev(col("minutes"))}
    got = {r[0]: r[1:] for r in rows(f.group_by("way").aggregate(spec), "way", *spec)}
    assert got["bus"] == (4, 3, 45.0, 15.0, 3.0) and got["tram"] == (1, 1, 9.5, 9.5, 0.0) and got["walk"] == (1, 0, 0.0, None, None)
    assert got[None][:4] == (2, 2, 61.0, 30.5) and abs(got[None][4] - math.sqrt(0.5)) < 1e-12
    assert rows(f.group_by().aggregate({"n": fn.count()}), "n") == [(8,)]
    with pytest.raises(TypeError):
        f.with_columns({"x": fn.mean(col("minutes"))})
    with pytest.raises(TypeError):
        f.group_by("way").aggregate({"x": col("minutes")})


def test_over_all(spark):
    f = Frame(spark.createDataFrame([(v,) for v in (8.0, 0.5, None, 3.5)], "depth double"))
    mean = fn.mean(col("depth")).over_all()
    assert sorted(r[0] for r in rows(f.drop_null().with_columns({"d": col("depth") - mean}), "d")) == [-3.5, -0.5, 4.0]
    assert rows(f.filter(col("depth").gt(mean)), "depth") == [(8.0,)]


def test_joins(spark):
    rivers = Frame(spark.createDataFrame([(7, "Aller"), (8, "Leine"), (9, "Oker"), (9, "Ilse"), (None, "Ecker")], "basin int, name string"))
    gauges = Frame(spark.createDataFrame([(9, "north"), (9, "south"), (3, "west"), (None, "east")], "basin int, name string"))
    assert {how: rivers.join(gauges, "basin", how).length() for how in ("inner", "left", "right", "outer")} == {"inner": 4, "left": 7, "right": 6, "outer": 9}
    assert rivers.join(gauges, "basin", "outer").columns == ["basin", "name", "name_right"]
    real = Frame(spark.createDataFrame([(8.0, 1), (8.5, 2)], "basin double, z int"))
    joined = rivers.join(real, "basin")
    assert dict(joined.df.dtypes)["basin"] == "int" and rows(joined, "name", "z") == [("Leine", 1)]
    with pytest.raises(ValueError):
        rivers.join(gauges, "basin", "cross")


def test_order(spark):
    f = Frame(spark.createDataFrame([(5, "m"), (4, None), (3, "d"), (2, "m"), (1, "x")], "at int, kind string"), "at")
    assert [r[0] for r in rows(f.sort_by("kind"), "at")] == [3, 2, 5, 1, 4]
    assert [r[0] for r in rows(f.sort_by(desc("kind")), "at")] == [1, 2, 5, 3, 4]
    assert [r[0] for r in rows(f.sort_by(desc("at")).slice(1, 3), "at")] == [4, 3]


def test_concat_and_series(spark):
    a = Frame(spark.createDataFrame([(0.25,), (None,)], "level double"))
    b = Frame(spark.createDataFrame([(6,)], "level int"))
    assert sorted(r[0] or -1 for r in rows(concat([a, b, a.limit(0)]), "level")) == [-1, 0.25, 6.0]
    with pytest.raises(ValueError):
        a.concat(Frame(spark.createDataFrame([(1.0,)], "depth double")))
    said = ["no", "yes", "yes", None, "no", "yes", "maybe"]
    s = Frame(spark.createDataFrame(list(enumerate(said)), "o int, v string").repartition(2, "v"), "o").get_series("v")
    assert [tuple(r) for r in s.value_counts().collect()] == [("yes", 3), ("no", 2), (None, 1), ("maybe", 1)]
    assert [r[0] for r in s.unique().orderBy("first").collect()] == ["no", "yes", None, "maybe"]
    assert s.get(2) == "yes" and s.get(3) is None and s.to_list() == said
    with pytest.raises(TypeError):
        s.cast("int64")
    with pytest.raises(TypeError):
        s.to_tensor()
    n = Frame(spark.createDataFrame([(3, 30), (1, 10), (2, 20)], "o int, v int"), "o").get_series("v")
    assert n.to_tensor().shape == (3,) and {tuple(r) for r in n.to_tensor().df.collect()} == {(0, 10.0), (1, 20.0), (2, 30.0)}


def test_csv_and_rows(spark, tmp_path):
    f = Frame(spark.createDataFrame([("red, dark", 0.5, [1, 2]), (None, 4.0, None), ('5" nail', -1.0, [])], "item string, price double, sizes array<int>").coalesce(1))
    assert f.to_csv() == 'item,price,sizes\n"red, dark",0.5,"[1,2]"\n,4,\n"5"" nail",-1,[]\n'
    text.write_csv(f, str(tmp_path / "csv"))
    assert "".join(p.read_text() for p in (tmp_path / "csv").glob("part-*")) == f.to_csv()
    t = Frame(spark.sql("SELECT timestamp_ntz'2031-07-04 23:59:58.25' AS t"))
    assert t.to_csv() == "t\n2031-07-04T23:59:58.250Z\n" and t.to_rows() == [{"t": 1940975998250000}]


def test_strict_types(spark):
    df = spark.range(1).select(F.create_map(F.lit("a"), F.lit(1)).alias("m"), F.col("id"))
    with pytest.raises(UnsupportedTypeError, match="m"):
        check_strict(df)
    check_strict(df, ["id"])


def test_filter_reaches_the_scan(spark, tmp_path):
    spark.range(1000).selectExpr("id", "id * 2 AS v", "id * 3 AS w").write.parquet(str(tmp_path / "t"))
    f = Frame(spark.read.parquet(str(tmp_path / "t"))).filter(col("id").gt(int64(990))).select("id", "v")
    plan = f.df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,990)" in plan and "w" not in plan.split("ReadSchema")[1]
