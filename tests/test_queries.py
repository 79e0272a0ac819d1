"""The driver's queries against DuckDB on the smallest tables, and the entry points."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from jagspark import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
#: One of each family; the driver compares all.
NAMES = "ew_div ew_mod ew_nextafter rag_sum rag_argsort rag_combinations arr_cumsum arr_unflatten hist1d hist_systematics join_outer join_grouped route_sha256 adl_q5 adl_q6 adl_q8 ttbar_4j1b udf_model io_ordinal io_creation".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql()) and len(catalog.queries()) > 200
    assert set(catalog.queries()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got, want = catalog.queries()[name](spark, SF).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    rows = lambda f: sorted(map(repr, f[columns].astype(object).where(f[columns].notna(), None).values.tolist()))
    assert columns == sorted(want.columns) and rows(got) == rows(want)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["bin", "n"] and df.count() == 50
