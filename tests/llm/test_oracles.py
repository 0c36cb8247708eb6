"""Registered queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest
from mailquarry.llm import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the generated tables aren't here")


def rows(df):
    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if isinstance(v, float) and v.is_integer():
            v = int(v)  # a column of numbers with nulls
        return str(int(v)) if isinstance(v, (bool, int)) or hasattr(v, "dtype") and v.dtype.kind in "iub" else str(v)

    names = sorted(df.columns)
    return names, sorted(tuple(map(cell, r)) for r in df[names].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(FOLDER):
        db.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    assert rows(registry.QUERIES[name](spark, FOLDER).toPandas()) == rows(db.sql(registry.ORACLES[name]).df())


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))


def test_queries_run_whole(spark):
    n = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    for name in ("op3_toxicity", "op4_pii_pseudonyms", "op5_language_id", "op1_simhash_near_dedup"):
        assert registry.QUERIES[name](spark, FOLDER).count() == n
