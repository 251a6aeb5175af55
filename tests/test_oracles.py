"""Every registered query with an oracle, on the smallest tables, against DuckDB."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from check_oracles import rows_of
from tests.conftest import SMALL

ORACLES = contract.oracle_sql()
# on a few hundred units the ends of resampled intervals move too much for a verdict
NAMES = [n for n in ORACLES if not n.endswith("bootstrap_verdict")]


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, tables, name):
    df = contract.queries()[name](spark, SMALL)
    cursor = tables.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cursor.fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() == 2
