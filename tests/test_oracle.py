"""Every registered query against its DuckDB oracle (row count, column
names, exact values after sorting).  Runs at TESSERA_ORACLE_SF (sf0.01)."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import _rows  # noqa: E402
from tessera.plans.registry import all_oracle_sql, all_queries  # noqa: E402
from tessera.sources.tables import SCHEMAS, table_path  # noqa: E402

QUERIES = all_queries()
SQL = all_oracle_sql()


@pytest.fixture(scope="module")
def con(sf_oracle):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in SCHEMAS:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_oracle, t)}')")
    return c


def test_every_query_has_an_oracle_and_is_registered():
    assert set(QUERIES) - set(SQL) == set()
    assert set(QUERIES) <= set(E.queries()) and set(SQL) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, sf_oracle, name):
    df = QUERIES[name](spark, sf_oracle)
    rows = [tuple(r) for r in df.collect()]
    if name not in SQL:
        assert len(rows) > 0
        return
    cur = con.execute(SQL[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert _rows(df.columns, rows, False) == _rows(ocols, orows, False)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "revenue_share" in df.columns
