"""Registered queries against their SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__
from raschmill.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted([norm(r[c]) for c in cols] for r in df.collect())
    sql = duck.sql(ORACLE[name])
    assert sorted(sql.columns) == cols
    at = [sql.columns.index(c) for c in cols]
    assert got == sorted([norm(r[i]) for i in at] for r in sql.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_has_rows(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() > 0 and df.where(" or ".join(f"`{c}` is null" for c in df.columns)).count() == 0


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["Item", "n", "mean_score", "mean_expected", "loglik"] and df.count() == 25
    assert set(ORACLE) <= set(__spark_entry__.oracle_sql()) and set(QUERIES) <= set(__spark_entry__.queries())
