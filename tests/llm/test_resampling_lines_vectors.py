import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import importance, line_dedup, whitening

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def runs(text, width):
    w = WORD.findall(text.lower())
    return [b" ".join(w[i : i + n]) for n in range(1, width + 1) for i in range(len(w) - n + 1)]


def odd_texts(rng, n):
    parts = [b"a", b"B", b"z9", b"7", b" ", b" ", b"-", "é".encode(), "\U0001f600".encode(), b"\n"]
    made = [b"".join(rng.choice(parts) for _ in range(rng.randrange(90))) for _ in range(n)]
    return [*made, b"", b"  ", b"x" * 300 + b" y " + b"q" * 400 + b" " + b"q" * 256, b"k" * 255]


@pytest.mark.parametrize("piece", [1 << 20, 50, 7])
@pytest.mark.parametrize("width", [1, 2, 3])
def test_features_are_checksums_of_runs(monkeypatch, piece, width):
    monkeypatch.setattr(importance, "PIECE", piece)
    texts = odd_texts(random.Random(3), 60)
    got, words = [], Counter()
    for owner, found, own in importance.features(texts, width, 10_007):
        got += zip(owner.tolist(), found.tolist())
        words.update(own.tolist())
    assert sorted(got) == sorted((k, zlib.crc32(r) % 10_007) for k, t in enumerate(texts) for r in runs(t, width))
    assert [words[k] for k in range(len(texts))] == [len(WORD.findall(t.lower())) for t in texts]


def plain_resample(rows, target, buckets, percent, least):
    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(zlib.crc32(r) % buckets for r in runs((x or "").encode(), 2))
    for x in target:
        t.update(zlib.crc32(r) % buckets for r in runs((x or "").encode(), 2))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for k, (i, x) in enumerate(rows):
        found = [zlib.crc32(r) % buckets for r in runs((x or "").encode(), 2)]
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(WORD.findall((x or "").lower().encode())) >= least))
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0]))
    ranks = {}
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        ranks.setdefault(r, []).append(k + 1)
    return sorted((r[:4] + ((ranks[r].pop(0) if ranks.get(r) else None),) for r in out), key=repr)


def test_resample_against_plain_version(spark):
    rng = random.Random(11)
    rows = [(k, " ".join(rng.choice(["ab", "cd", "Ef", "g7", "hé"]) for _ in range(rng.randrange(2, 40)))) for k in range(400)]
    rows += [(400, None), (401, ""), (402, "!!"), (None, "ab cd ef " * 10), (5, rows[5][1]), (5, rows[5][1])]
    target = ["ab cd ab cd", None, "", "g7 ab"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rank", F.lit("x")).withColumn("row", F.lit(1)).repartition(3)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(docs, bench, buckets=97)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_resample(rows, target, 97, 25, 20)


def test_resample_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id string, text string")
    some = spark.createDataFrame([("a", "one two"), ("b", None)], "doc_id string, text string")
    assert importance.resample(empty, some).count() == 0
    assert sorted(r["rank"] is None for r in importance.resample(some, empty).collect()) == [True, True]
    assert [r["rank"] for r in importance.resample(some, some, percent=100, least_words=0).orderBy("rank").collect()] == [1, 2]


@pytest.mark.parametrize("k", [1, 2, 31, 32, 500, 1999, 2000])
def test_kth_key(spark, k):
    rng = random.Random(k)
    keys = [(rng.randrange(7), None if j % 50 == 0 else rng.randrange(30), j) for j in range(2000)]  # many ties and nulls
    df = spark.createDataFrame([(key,) for key in keys], "key struct<down:long,id:long,row:long>")
    assert tuple(importance.kth_key(df, "key", k)) == sorted(keys, key=lambda x: (x[0], x[1] is not None, x[1], x[2]))[k - 1]


# --- lines ---


def plain_lines(rows, least, documents):
    key = lambda line: line.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)})
    held = {}
    for k, (i, t) in enumerate(rows):
        for x in {key(line) for line in (t or "").split("\n")}:
            if len(x) >= least:
                held.setdefault(x, []).append(i)
    last = {x: max((i for i in ids if i is not None), default=None) for x, ids in held.items() if len(ids) >= documents}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [line for line in lines if key(line) not in last or last[key(line)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def line_rows():
    rng = random.Random(2)
    pool = ["".join(rng.choice("abcdeFé中 \t") for _ in range(rng.randrange(3, 30))) for _ in range(150)]
    pool += ["x" * 19, "x" * 20, "é" * 19, "é" * 20, "É" * 20, " \t" + "y" * 20 + "\f", "Y" * 20, " " + "y" * 20, "", "\r"]
    rows = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randrange(9)))) for k in range(300)]
    long = "\n".join(f"line number {k} of a long text" for k in range(5000))
    same = "a licence line in every document"
    return [*[(i, f"{same}\n{t}") for i, t in rows], (300, None), (301, ""), (302, long), (303, long), (304, long), (None, same), (7, rows[7][1]), (304, long)]


def test_lines_against_plain_version(spark):
    rows = line_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("keys", F.lit(1)).withColumn("mark", F.lit("x")).repartition(5)
    got = line_dedup.drop_lines(docs)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_lines(rows, 20, 3)


def test_lines_with_full_filters(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "MIN_BITS", 64)
    monkeypatch.setattr(line_dedup, "MAX_BITS", 64)
    monkeypatch.setattr(line_dedup, "CHUNK", 32)
    rows = line_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, line_dedup.drop_lines(docs, documents=2, least=5).collect()), key=repr) == plain_lines(rows, 5, 2)


@pytest.mark.parametrize("bits", [1 << 18, 1 << 21])
def test_filters_suspect_repeats_and_little_else(spark, bits):
    rows = [(k, f"a line that document {k} has for itself\n" + ("a line that two have: %d of them" % (k // 2) if k < 200 else "")) for k in range(3000)]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(6).select("id", F.xxhash64("text").alias("mark"), F.col("text").cast("binary").alias("text"))
    found = line_dedup.suspects(docs, bits, 20)
    assert 200 <= found.count() <= 200 + 30
    assert found.groupBy("key").count().where("count = 2").count() >= 100


def test_lines_of_empty_table(spark):
    assert line_dedup.drop_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- vectors ---


def fixed_matrix(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    v = (q * np.asarray(values)) @ q.T
    return (v + v.T) / 2


@pytest.mark.parametrize(
    "values",
    [np.arange(1, 41.0), np.r_[np.ones(15), np.full(25, 2.0)], 1 + 1e-7 * np.arange(30), np.r_[1 + 1e-10 * np.arange(20), 3 + 1e-13 * np.arange(20)], np.logspace(0, -11, 40), np.r_[np.zeros(10), np.arange(1, 9.0)], np.ones(5)],
)
def test_refined_vectors_beat_double_precision(values):
    v = fixed_matrix(values)
    e, x = whitening.refined_eigen(v)
    wide = v.astype(np.longdouble)
    rest = np.abs(wide @ x - x * e.astype(np.longdouble)).max() / np.abs(v).max()
    assert rest < 1e-15 and np.abs(x.T.astype(np.longdouble) @ x - np.eye(len(v))).max() < 1e-15
    assert (np.diff(e) <= 0).all() and np.abs(np.sort(values)[::-1] - e).max() < 1e-13 * max(values)


def test_well_separated_vectors_are_accurate_to_the_last_digits():
    d = np.arange(1, 30.0)
    t = np.zeros((29, 29))  # a Householder reflection of a diagonal matrix: vectors are known
    u = np.random.default_rng(4).integers(-3, 4, 29).astype(float)
    h = np.eye(29) - 2 * np.outer(u, u) / (u @ u)
    t[:] = h @ np.diag(d) @ h
    _, x = whitening.refined_eigen((t + t.T) / 2)
    want = h[:, ::-1]
    assert np.abs(x * np.sign((x * want).sum(0)) - want).max() < 5e-15


def plain_whiten(rows, components):
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    size = max(len(v) for _, v in rows if v)
    good = [(i, np.floor(64 * np.float32(v).astype(float)).astype(int) + 1_000_000) for i, v in good if len(v) == size]
    n, sums = len(good), sum(x for _, x in good)
    deviation = [sum(int(a) ** 2 for a in n * x - sums) for _, x in good]
    c = np.array([x - sums / n for _, x in good])
    e, w = np.linalg.eigh(c.T @ c / n)
    e, w = e[::-1][:components], w[:, ::-1][:, :components]
    return [i for i, _ in good], deviation, c @ w / np.sqrt(e), e / np.trace(c.T @ c / n), n


def test_whiten_against_plain_version(spark):
    rng = np.random.default_rng(8)
    rows = [(k, [float(np.float32(x)) for x in rng.normal(size=6) * [5, 4, 3, 2, 1, 0.5] + 100]) for k in range(500)]
    rows += [(500, None), (501, []), (502, [1.0] * 5), (503, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (504, [math.nan] * 6), (505, [math.inf] + [0.0] * 5), (9, rows[9][1]), (None, rows[4][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("n", F.lit("x")).withColumn("z", F.lit(1)).repartition(4)
    got = whitening.whiten(table, components=4)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    ids, deviation, z, explained, n = plain_whiten(rows, 4)
    found = got.toPandas()
    assert len(found) == 4 * n == 4 * 502 and set(found["n"]) == {n} and set(found["component"]) == {1, 2, 3, 4}
    one = found[found["component"] == 1]
    as_id = lambda i: -1 if i is None or i != i else int(i)
    assert sorted(zip(map(as_id, one["vec_id"]), map(int, one["deviation"]))) == sorted(zip(map(as_id, ids), deviation))
    for c in range(4):
        part = found[found["component"] == c + 1]
        mine = dict(zip(map(as_id, part["vec_id"]), part["whitened"]))
        sign = math.copysign(1, mine[0] * z[ids.index(0), c])
        assert max(abs(sign * mine[as_id(i)] - z[k, c]) for k, i in enumerate(ids)) < 1e-11
        assert np.allclose(part["explained"], explained[c], rtol=1e-13)
    assert found["identity_error"].iloc[0] < 1e-12


def test_deviations_beyond_64_bits(spark):
    fitted = object.__new__(whitening.Whitener)
    fitted.n, fitted.centre, fitted.sums = 3_000_000_000, np.array([5, 7]), np.array([5 * 3_000_000_000 + 11, 7 * 3_000_000_000 - 13])
    y = np.array([[1000, -2000], [5, 7]])
    a, b, c = fitted.deviations(y)
    want = [sum((fitted.n * int(v) - int(s)) ** 2 for v, s in zip(row, fitted.sums)) for row in y]
    assert [int(p) * 2**62 + int(q) * 2**31 + int(r) for p, q, r in zip(a, b, c)] == want


def test_whiten_odd_tables(spark):
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, []), (3, [None])], "vec_id long, embedding array<float>")
    assert whitening.whiten(nothing).count() == 0
    alike = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert whitening.whiten(alike).count() == 0
    line = spark.createDataFrame([(k, [float(k), 2.0 * k]) for k in range(4)], "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whiten(line).collect()} == {1}


DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_line_dedup"])
def test_queries_against_sql(spark, name):
    import duckdb

    from larkspur.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    assert sorted(map(tuple, QUERIES[name](spark, DIR).select(*want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)
