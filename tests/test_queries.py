"""Every registered query over the smallest tables: against its SQL, or for a stable schema."""

import os

import duckdb
import pytest

from veilgraph import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(SF):
        path = f"{SF}/{name}"
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    if name in SQL:
        told = con.sql(SQL[name])
        assert sorted(told.columns) == columns
        at = [told.columns.index(c) for c in columns]
        assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in told.fetchall())
    elif name not in ("address_spans", "suspicion_shortlist", "encoded_tokens"):  # the smallest tables have none
        assert got


def test_names_of_sql_are_queries():
    assert set(SQL) <= set(registry.queries())
