"""Every named query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from dagframe import catalog

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    return con


def _plain(row):
    return tuple(None if v is None or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in row)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, sql, name):
    df = catalog.QUERIES[name](spark, SMALL)
    names = sorted(df.columns)
    got = [_plain(r) for r in df.select(*names).collect()]
    found = sql.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == names
    order = [columns.index(n) for n in names]
    want = [_plain(r[i] for i in order) for r in found.fetchall()]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_entry_runs(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 3
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
