"""Every query that SQL can express, against DuckDB on the same tables."""

import pytest
from oracle import connect, difference

from tidemark import registry

SQL = registry.oracle_sql()
#: Queries that find nothing in the smallest tables; they have rows in larger ones.
EMPTY = {"expand_pairs", "expand_peers", "expand_research", "expand_watchlist", "overheated", "pair_stat_precedence", "relative_lag"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf, con, name):
    assert difference(spark, con, registry.queries()[name], SQL[name], sf) == ("no rows" if name in EMPTY else None)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
