"""Byte ranges of tensor files and filters of user-supplied tables."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import EqualTo, GreaterThan, StringStartsWith

from larkspur.sources import lazy, tensors

HELD = {"a": np.arange(1000.0), "b": np.arange(6, dtype=np.float32).reshape(2, 3), "c": np.ones(50_000), "d": np.array([7, 8], np.int64), "e": np.zeros(0, np.float32), "f": np.float16([1.5, -2])}


@pytest.fixture
def file(tmp_path):
    path = f"file://{tmp_path}/some/m.safetensors"
    tensors.write_tensors(path, HELD, {"kind": "test"})
    return path


def values(df):
    out = {}
    for r in df.orderBy("name", "start").collect():
        assert r["start"] == len(out.get(r["name"], []))
        out[r["name"]] = [*out.get(r["name"], []), *r["values"]]
    return out


@pytest.mark.parametrize("gap, most", [(0, 1 << 25), (1 << 20, 1 << 25), (64, 1000), (0, 9)])
def test_all_tensors_in_any_ranges(spark, file, gap, most):
    if most == 9:
        got = values(tensors.read_many(spark, file, ["b", "d", "e"], gap=gap, most=most))
        assert got == {"b": [0, 1, 2, 3, 4, 5], "d": [7, 8], "e": []}
    else:
        got = values(tensors.read_many(spark, file, gap=gap, most=most))
        assert {k: list(map(float, v.ravel())) for k, v in HELD.items()} == got


def test_only_wanted_bytes_are_read(spark, file, monkeypatch):
    read, plain = [], tensors.read_bytes
    monkeypatch.setattr(tensors, "read_bytes", lambda path, start, size: read.append(size) or plain(path, start, size))
    reader = tensors.TensorReader([file], {"b", "d"}, gap=0, most=1 << 20)
    parts = reader.partitions()
    head = sum(read)
    rows = [b.to_pylist()[0] for p in parts for b in reader.read(p)]
    assert {r["name"]: r["values"] for r in rows} == {"b": [0, 1, 2, 3, 4, 5], "d": [7, 8]}
    assert len(parts) == 2 and sum(read) - head == 24 + 16 and head < 1000
    near = tensors.TensorReader([file], {"a", "b"}, gap=0, most=1 << 20).partitions()
    assert [p.size for p in near] == [8024]  # side by side: one read
    over = tensors.TensorReader([file], {"b", "d"}, gap=1 << 19, most=1 << 20).partitions()
    assert [p.size for p in over] == [24 + 400_000 + 16]  # the gap is read along


def test_filters_narrow_the_ranges(spark, file):
    reader = tensors.FilteredTensorReader([file], None, 0, 1 << 20)
    rest = list(reader.pushFilters([EqualTo(("name",), "d"), StringStartsWith(("name",), "d"), GreaterThan(("start",), 0)]))
    assert rest == [GreaterThan(("start",), 0)] and [p.size for p in reader.partitions()] == [16]
    spark.conf.set(lazy.PUSHED, "true")
    try:
        assert values(tensors.read_many(spark, file).where("name = 'd'")) == {"d": [7, 8]}
    finally:
        spark.conf.set(lazy.PUSHED, "false")


def test_broken_files(spark, tmp_path):
    with pytest.raises(KeyError):
        tensors.write_tensors(f"{tmp_path}/x.safetensors", HELD)
        tensors.read_many(spark, f"{tmp_path}/x.safetensors", ["nothing"])
    raw = (tmp_path / "x.safetensors").read_bytes()
    for name, bad in (("short", raw[:5]), ("cut", raw[:-1]), ("long", raw + b"x"), ("size", b"\xff" * 8 + raw[8:])):
        (tmp_path / f"{name}.safetensors").write_bytes(bad)
        with pytest.raises(ValueError):
            tensors.header(f"{tmp_path}/{name}.safetensors")


def test_shards_round_trip(spark, tmp_path):
    rows = [(k, [float(k), k / 2, -1.0], k * 3) for k in range(500)]
    df = spark.createDataFrame(rows, "k long, v array<float>, m int").repartition(4)
    paths = tensors.write_shards(df, f"file://{tmp_path}/shards", {"k": "I64", "v": "F32", "m": "I32"})
    assert len(paths) == 4 == len(tensors.files_of(f"file://{tmp_path}/shards"))
    read = tensors.read_many(spark, f"file://{tmp_path}/shards", gap=0, most=100)
    k, v, m = (tensors.rows_of(read.where(F.col("name").startswith(f"{n}/")), w).withColumnRenamed("values", n) for n, w in (("k", 1), ("v", 3), ("m", 1)))
    both = k.join(v, ["path", "number", "row"]).join(m, ["path", "number", "row"])
    assert sorted((int(r["k"]), r["v"], int(r["m"])) for r in both.collect()) == rows
    with pytest.raises(Exception, match="holds nulls"):
        tensors.write_shards(spark.createDataFrame([(None,)], "k long"), f"{tmp_path}/no", {"k": "I64"})


@pytest.mark.parametrize("pushed", ["true", "false"])
def test_filters_of_user_tables(spark, pushed):
    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("s", T.StringType())])

    def read(part, wanted, tests):
        least = max([v for c, o, v in tests if c == "n" and o in (">", ">=")], default=0)
        n = [k for k in range(part, part + 10) if k >= least]
        yield pa.RecordBatch.from_arrays([pa.array(n), pa.array([f"{wanted}{len(tests)}"] * len(n))], ["n", "s"])

    spark.conf.set(lazy.PUSHED, pushed)
    try:
        found = lazy.from_lazy_source(spark, f"pushed_{pushed}", schema, [0, 10, 20], read, filtered=True).where("n > 14 AND s IS NOT NULL").collect()
    finally:
        spark.conf.set(lazy.PUSHED, "false")
    assert sorted(r["n"] for r in found) == list(range(15, 30))
    assert {r["s"][-1] for r in found} == ({"0"} if pushed == "false" else {"1"})
