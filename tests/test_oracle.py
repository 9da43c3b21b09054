"""Every query of the core with SQL against DuckDB on the smallest tables."""

import pytest
from oracle import compare, duck

from kgweave.plans import evaluation, graph_analytics, graph_build, incremental, integrity, models, resolution, search, text_cleaning

MODULES = [search, text_cleaning, resolution, graph_build, graph_analytics, evaluation, models, integrity, incremental]
QUERIES = {n: q for m in MODULES for n, q in m.QUERIES.items()}
SQL = {n: q for m in MODULES for n, q in getattr(m, "SQL", {}).items()}


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def test_sql_has_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf, con, name):
    assert compare(QUERIES[name](spark, sf), con, SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"community_hierarchy", "community_levels"}))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).limit(5).collect() is not None


def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert len(rows) == 5 and [r["rank"] for r in rows] == [1, 2, 3, 4, 5]
    assert set(e.oracle_sql()) <= set(e.queries())
