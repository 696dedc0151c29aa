"""Queries over rows written out, against the rows that are expected of them."""

import collections

import duckdb
import pytest

from quarryloom.plans import catalog, fixtures

NAMES = sorted(n for n, f in catalog.QUERIES.items() if f.__module__ == fixtures.__name__)


@pytest.mark.parametrize("name", NAMES)
def test_rows(spark, name):
    found = catalog.QUERIES[name](spark, "")
    columns = sorted(found.columns)
    want = duckdb.sql(catalog.ORACLES[name])
    assert sorted(want.columns) == columns
    rows = lambda r: collections.Counter(map(repr, r))
    assert rows(tuple(x) for x in found.select(*columns).collect()) == rows(want.project(", ".join(columns)).fetchall())
