"""Every catalogued query against its SQL on the smallest tables."""

import datetime
import decimal

import duckdb
import numpy as np
import pandas as pd
import pytest

from parcelspark.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(x):
    if np.isscalar(x) and pd.isna(x) or x is None or x is pd.NA or x is pd.NaT:
        return "null"
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (int, float, decimal.Decimal, np.integer, np.floating)):
        return f"{float(x):.4f}".replace("-0.0000", "0.0000")
    if isinstance(x, (datetime.date, pd.Timestamp)):
        return str(pd.Timestamp(x))
    return str(x)


def rows_of(df):
    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, small, name):
    got, want = catalog.QUERIES[name](spark, small).toPandas(), duck.execute(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_other_queries_run(spark, small, name):
    assert catalog.QUERIES[name](spark, small).count() > 0
