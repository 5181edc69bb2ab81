"""Registered queries of the reference's operators against their DuckDB SQL over the smallest tables."""

import glob
import math
import os

import pytest

import jobs.queries  # noqa: F401
import ledgerloom.plans  # noqa: F401
from ledgerloom.plans import catalog


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    return repr(value)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want = con.execute(catalog.ORACLES[name]).fetchall()
    columns = [d[0] for d in con.description]
    found = catalog.QUERIES[name](spark, sf)
    assert sorted(columns) == sorted(found.columns)
    rows = [tuple(r) for r in found.select(*columns).collect()]
    assert sorted(tuple(map(plain, r)) for r in rows) == sorted(tuple(map(plain, r)) for r in want)


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark)
    assert rows.count() > 0 and "error" in rows.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
