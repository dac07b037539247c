"""Every registered query that has a SQL twin gives its rows at the smallest scale."""

import os

import duckdb
import pytest

from larkspur.plans import operator_queries, series_queries, statistics_queries, tensor_queries  # noqa: F401
from larkspur.plans.registry import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return float(f"{v:.8g}")
    return [cell(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DIR)
    got = df.collect()
    assert got or name == "null_counts"
    if name in ORACLE_SQL:
        con = duckdb.connect()
        for t in TABLES:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
        want = con.sql(ORACLE_SQL[name])
        order = sorted(df.columns)
        assert order == sorted(want.columns)
        rows = [dict(zip(want.columns, r)) for r in want.fetchall()]
        key = lambda r: repr([cell(r[c]) for c in order])
        a, b = sorted(map(key, (r.asDict() for r in got))), sorted(map(key, rows))
        assert [x.replace(".0", "") for x in a] == [x.replace(".0", "") for x in b]
