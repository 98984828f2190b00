"""Every registered query runs; those with SQL equal DuckDB's answer."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from grainmill.plans import registry


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def ordered(df):
    cols = sorted(df.columns)
    return df[cols].sort_values(cols, key=lambda v: v.astype(str), ignore_index=True)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(name, spark, sf, duck):
    got, want = registry.QUERIES[name](spark, sf).toPandas(), duck.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(ordered(got).astype(object), ordered(want).astype(object), check_dtype=False, rtol=1e-9)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(name, spark, sf):
    assert registry.QUERIES[name](spark, sf).toPandas() is not None


def test_names_match():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
