"""Every registered query with SQL against DuckDB on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pandas as pd
import pytest

from weftline.plans import queries as tabular

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


def cell(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
        return "NULL"
    if isinstance(v, (datetime.date, pd.Timestamp)):
        return str(pd.Timestamp(v))
    if isinstance(v, (int, float, decimal.Decimal)) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "iuf":
        return f"{float(v):.9g}"
    return str(v)


def normal(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(tabular.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(tabular.oracle_sql()[name]).df()
    got = tabular.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)
