"""Registered queries of the engine against their SQL on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest
from mailquarry.plans.catalogue import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the generated tables aren't here")


@pytest.fixture(scope="module")
def db():
    out = duckdb.connect()
    out.execute("SET timezone = 'UTC'")
    for f in os.listdir(FOLDER):
        out.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return out


def rows(df):
    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if isinstance(v, float):
            return f"{v:.6f}"
        return str(int(v)) if isinstance(v, (bool, int)) or hasattr(v, "dtype") and v.dtype.kind in "iub" else str(v)

    names = sorted(df.columns)
    kinds = {n: pd.api.types.is_float_dtype(df[n]) and not (df[n].dropna() % 1).any() for n in names}
    for n, whole in kinds.items():
        if whole:
            df[n] = df[n].astype("Int64")
    return names, sorted(tuple(map(cell, r)) for r in df[names].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, db, name):
    assert rows(QUERIES[name](spark, FOLDER).toPandas()) == rows(db.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 138
    assert set(ORACLES) <= set(QUERIES) <= set(__spark_entry__.queries())
