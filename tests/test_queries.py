"""Every registered query with SQL, against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from tessera.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(columns, found):
    order = sorted(columns)
    at = [list(columns).index(c) for c in order]
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else v + 0.0 if isinstance(v, float) else v
    return order, sorted((tuple(plain(r[i]) for i in at) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    relation = duck.sql(SQL[name])
    (ours, a), (theirs, b) = rows(df.columns, df.collect()), rows(relation.columns, relation.fetchall())
    assert ours == theirs and len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == pytest.approx(y, rel=1e-6, abs=1e-6, nan_ok=True) if all(isinstance(v, int | float) for v in (*x, *y)) else x == y


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).collect()
    assert got
    if name == "causality_check":
        assert all(r.leaks == 0 for r in got)


def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns == ["ts", "factor"] and out.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
