"""The queries of this package against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from sieveline.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got, want = QUERIES[name](spark, SF).toPandas(), c.sql(SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    told = lambda d: sorted(map(repr, d[cols].astype(object).values.tolist()))
    assert told(got) == told(want)
