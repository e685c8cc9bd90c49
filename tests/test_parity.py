"""Every query with SQL gives the rows that DuckDB gives."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from graphloom import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, np.ndarray | list | tuple):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, data, duck, name):
    df = catalog.queries()[name](spark, data)
    names = sorted(df.columns)
    cursor = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == names
    order = lambda rows: sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))
    want = order([tuple(plain(r[columns.index(c)]) for c in names) for r in cursor.fetchall()])
    assert order([tuple(plain(r[c]) for c in names) for r in df.collect()]) == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_gives_rows(spark, data, name):
    assert catalog.queries()[name](spark, data).count() > 0
