"""Every query against its SQL on the smallest tables; the others must run."""

import hashlib
import math
import os
import re

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from argosift.plans import registry

DATA = os.environ.get("ARGOSIFT_DATA", "/root/testdata") + "/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def cell(v):
    if isinstance(v, (list, np.ndarray)):
        return str([cell(x) for x in v])
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, float, np.integer, np.floating)):
        return repr(round(float(v), 6) + 0.0)
    return str(v)


def rows(df):
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name not in SQL:
        assert len(got.columns)
        return
    want = duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize(("name", "table", "key", "column"), [("hard_negatives_all", "part", "p_partkey", "a"), ("latin_assignment", "orders", "o_orderkey", "o_orderkey")])
def test_every_id_is_asked(spark, name, table, key, column):
    keys = pd.read_parquet(f"{DATA}/{table}.parquet", columns=[key])[key]
    assert sorted(QUERIES[name](spark, DATA).toPandas()[column]) == sorted(keys)


def test_pagerank_has_settled(spark):
    li = pd.read_parquet(f"{DATA}/lineitem.parquet", columns=["l_partkey", "l_suppkey"])
    e = pd.DataFrame({"s": li["l_partkey"], "d": li["l_suppkey"] + 10**7}).drop_duplicates()
    ids = sorted({*e["s"], *e["d"]})
    at = {x: i for i, x in enumerate(ids)}
    m = np.zeros((len(ids), len(ids)))
    m[e["d"].map(at), e["s"].map(at)] = 1
    out = m.sum(axis=0)
    m = np.where(out > 0, m / np.where(out > 0, out, 1), 1 / len(ids))
    want = np.linalg.solve(np.eye(len(ids)) - 0.85 * m, np.full(len(ids), 0.15 / len(ids)))
    got = QUERIES["pagerank"](spark, DATA).toPandas().set_index("id")["rank"].loc[ids].to_numpy()
    assert np.abs(got - want).max() < 2e-8


def test_bootstrap_takes_10000_resamples(spark):
    li = pd.read_parquet(f"{DATA}/lineitem.parquet", columns=["l_returnflag", "l_suppkey", "l_quantity"])
    got = QUERIES["cluster_bootstrap"](spark, DATA).toPandas().set_index("l_returnflag")
    for flag, g in li.groupby("l_returnflag"):
        m = g.groupby("l_suppkey")["l_quantity"].mean().sort_index().astype(float).to_numpy()
        draws = [[int(hashlib.md5(f"20260421|{r}|{j}".encode()).hexdigest()[:8], 16) % len(m) for j in range(len(m))] for r in range(10_000)]
        means = np.sort(m[np.array(draws)].mean(axis=1))
        assert (got.loc[flag, "low"], got.loc[flag, "high"]) == (pytest.approx(means[250], abs=2e-6), pytest.approx(means[9749], abs=2e-6))


def test_permutations_are_10000(spark):
    p = QUERIES["permutation_trend"](spark, DATA).first()["p"]
    assert abs(p * 10_001 - round(p * 10_001)) < 0.01


def test_leak_guard_looks_for_whole_items(spark, tmp_path):
    item = "An opening of more than sixty characters that many other texts share, " + "and a rest that is the item's own."
    spark.createDataFrame([(1, item)], "item_id int, text string").write.parquet(str(tmp_path / "heldout_items.parquet"))
    spark.createDataFrame([(1, "x " + item.upper()), (2, item[:70]), (3, None)], "doc_id int, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [tuple(r) for r in QUERIES["leak_guard"](spark, str(tmp_path)).collect()] == [(1, 1)]
