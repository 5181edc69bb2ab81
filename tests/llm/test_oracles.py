"""Registered queries against their DuckDB SQL over the smallest tables."""

import pytest

from ledgerloom.llm import oracles, queries

from .util import duck


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_sql(spark, sf, name):
    found = queries.QUERIES[name](spark, sf)
    want, columns = duck(oracles.ORACLES[name], sf)
    assert sorted(columns) == sorted(found.columns)
    rows = [tuple(r) for r in found.select(*columns).collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 13))
