"""Registered queries with SQL equal DuckDB's answer."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from grainmill.llm import queries


def ordered(df):
    cols = sorted(df.columns)
    return df[cols].sort_values(cols, key=lambda v: v.astype(str), ignore_index=True)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(name, spark, sf):
    duck = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        duck.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = queries.QUERIES[name](spark, sf).toPandas(), duck.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(ordered(got).astype(object), ordered(want).astype(object), check_dtype=False, rtol=1e-9)
