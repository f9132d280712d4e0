import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from argosift.llm import queries

DATA = "/root/testdata/sf0.001"


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    return repr(round(float(v), 6) + 0.0) if isinstance(v, (int, float, np.integer, np.floating)) else str(v)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_and_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    got, want = queries.queries()[name](spark, DATA).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    flat = lambda df: sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))
    assert sorted(got.columns) == sorted(want.columns) and flat(got) == flat(want)
