"""All queries against their SQL on the smallest tables."""

import glob
import os
import subprocess
import sys

import duckdb
import pytest

from sieveline.queries import reference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(reference.QUERIES))
def test_query(spark, duck, name):
    got = reference.QUERIES[name](spark, SF).toPandas()
    if name not in reference.SQL:
        assert list(got.columns)
        return
    want = duck.sql(reference.SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    told = lambda d: sorted(map(repr, d[cols].astype(object).values.tolist()))
    assert told(got) == told(want)


def test_the_rest_stands_without_the_llm_package(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"import sys; sys.path.insert(0, {root!r})\nclass No:\n    def find_spec(self, name, *a):\n        if name.split('.')[:2] == ['sieveline', 'llm'] or name == 'corpus_pipeline':\n            raise ModuleNotFoundError(name, name=name)\nsys.meta_path.insert(0, No())\nimport __spark_entry__ as e\nassert 'infra_all' in e.queries() and 'pipeline' not in e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
