"""Every registered query against its SQL, over whole tables."""

from __future__ import annotations

import pytest
from compare import difference, oracle_connection

from __spark_entry__ import entry, oracle_sql, queries
from lakejobs.plans.registry import ORACLES, QUERIES

WITHOUT_SQL = {"s7_file_inventory", "t10_column_profile_approx", "t12_table_stats"}


@pytest.fixture(scope="module")
def connection(sf_dir):
    return oracle_connection(sf_dir)


def test_every_other_query_has_sql():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf_dir, connection, name):
    assert difference(spark, sf_dir, queries()[name], oracle_sql()[name], connection) is None


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_gives_rows(spark, sf_dir, name):
    assert queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry(spark).columns == ["word", "count"]
