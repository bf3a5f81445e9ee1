"""Every registered query of the library against its SQL twin over the small tables."""

from __future__ import annotations

import pytest

from harvestry import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(name, same_as_sql):
    same_as_sql(catalog.QUERIES[name], catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_runs(name, spark, sf):
    assert catalog.QUERIES[name](spark, sf).columns
