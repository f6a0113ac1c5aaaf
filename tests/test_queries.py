"""Each query of the library against its SQL on the small tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from loomline import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return ""
    return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_its_sql(spark, duck, name):
    a, b = Q.QUERIES[name](spark, SF).toPandas(), duck.execute(Q.SQL[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    rows = [sorted(map(tuple, df[cols].map(plain).to_numpy().tolist())) for df in (a, b)]
    assert rows[0] == rows[1]


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
