"""Every registered query against its SQL check."""

from __future__ import annotations

import pytest
from compare import connect, differences
from small import TESTDATA

import __spark_entry__ as entry

from haberdash.registry import QUERIES
from oracle import ORACLE_SQL as SQL

FOLDER = str(TESTDATA / "sf0.001")


@pytest.fixture(scope="module")
def checks():
    return connect(FOLDER)


def test_every_query_has_a_check():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, checks, name):
    assert differences(entry.queries()[name](spark, FOLDER), checks, SQL[name]) == []


def test_flagship(spark):
    result = entry.entry(spark)
    assert result.columns == [
        "order_year",
        "valid_orders",
        "total_customers",
        "net_revenue",
        "gross_profit",
    ]
    assert result.count() == 7
