"""Every query against its DuckDB SQL at the smallest scale; queries without SQL must give rows."""

import datetime
import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from folio.plans import catalogue
from folio.sources.views import TABLES


def norm(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 5)
    if isinstance(v, list | tuple | np.ndarray):
        return tuple(norm(x) for x in v)
    if isinstance(v, datetime.date):
        return pd.Timestamp(v).isoformat()
    return v


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, data, duck, name):
    got = catalogue.queries()[name](spark, data)
    cols = sorted(got.columns)
    rows = sorted((tuple(norm(x) for x in r) for r in got.select(*cols).collect()), key=repr)
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want = duck.execute(sql)
    names = [c[0] for c in want.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert rows == sorted((tuple(norm(r[i]) for i in order) for r in want.fetchall()), key=repr)
    assert rows
