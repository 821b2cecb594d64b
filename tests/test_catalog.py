"""Every catalogue query that SQL can express equals its SQL on the smallest tables."""

import math

import duckdb
import pytest

from lagweave import catalog

SF = "/root/testdata/sf0.001"
NAMES = sorted(catalog.ORACLE)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(r[i] if not isinstance(r[i], float) else round(r[i], 4) + 0.0 for i in order) for r in data)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "orders", "lineitem", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    want = con.sql(catalog.ORACLE[name])
    a, b = rows(df.columns, [tuple(r) for r in df.collect()]), rows(want.columns, want.fetchall())
    assert sorted(df.columns) == sorted(want.columns) and len(a) == len(b)
    for x, y in zip(a, b):
        assert all(u == v or (isinstance(u, float) and math.isclose(u, v, abs_tol=2e-4)) for u, v in zip(x, y))


def test_names_agree():
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)
