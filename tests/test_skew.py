"""One order, customer, product, center and session hold a third of all rows, in many slices."""

from __future__ import annotations

import pytest
from compare import connect, differences
from small import TESTDATA
from pyspark.sql import functions as F

from haberdash.operators.numbering import SLICE
from haberdash.registry import QUERIES
from haberdash.sources.testbed import TABLES, warehouse_over
from haberdash.sources.warehouse import Store
from oracle import ORACLE_SQL

# Queries that number rows in groups, and some that join or count by hot keys.
NAMES = (
    "clean_order_items",
    "clean_inventory",
    "clean_events",
    "fact_order_items",
    "orphan_census",
    "mismatch_customer",
    "mismatch_status",
    "mismatch_item_count",
    "mismatch_product",
    "mismatch_center",
    "dup_keys",
    "dup_session_sequence",
    "session_gaps",
    "session_multi_attr",
    "purchase_sequence",
    "product_rank_in_category",
    "one_time_vs_repeat",
    "new_vs_repeat_by_year",
    "by_country",
    "sales_monthly",
    "product_performance",
    "customer_performance",
    "distribution_center_performance",
    "order_fulfilment",
    "session_funnel",
)


SLICES = {
    "spark.sql.shuffle.partitions": "40",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    source = connect(str(TESTDATA / "sf0.001"))
    hot = {
        "lineitem": """SELECT * EXCLUDE (r) REPLACE (
              if(r % 3 = 0, 7, l_orderkey) AS l_orderkey, if(r % 3 = 1, 3, l_partkey) AS l_partkey,
              if(r % 3 = 2, 4, l_suppkey) AS l_suppkey)
            FROM (SELECT *, row_number() OVER () AS r FROM lineitem)
            UNION ALL SELECT l.* FROM (SELECT * FROM lineitem ORDER BY ALL LIMIT 1) AS l, range(40)""",
        "orders": "SELECT * REPLACE (if(o_orderkey % 3 = 0, 5, o_custkey) AS o_custkey) FROM orders",
        "part": "SELECT * REPLACE (if(p_partkey % 3 = 0, 'SMALL', p_type) AS p_type) FROM part",
        "events": """SELECT * REPLACE (if(event_id % 3 = 0, 2, user_id) AS user_id,
              if(event_id % 3 = 0, TIMESTAMP '2024-01-05 10:00:00' + to_milliseconds(event_id // 9), ts) AS ts)
            FROM events""",
    }
    for table in TABLES:
        query = hot.get(table, f"SELECT * FROM {table}")
        source.execute(f"COPY ({query}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.fixture(scope="module")
def split(spark, skewed, tmp_path_factory):
    """A warehouse whose rows are cut into many slices, so that large groups reach over several."""
    before = {name: spark.conf.get(name) for name in SLICES}
    for name, value in SLICES.items():
        spark.conf.set(name, value)
    yield warehouse_over(Store(spark, str(tmp_path_factory.mktemp("split"))), skewed)
    for name, value in before.items():
        spark.conf.set(name, value)


@pytest.fixture(scope="module")
def checks(skewed):
    return connect(skewed)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql_on_skewed_tables(split, checks, name):
    assert differences(QUERIES[name](split), checks, ORACLE_SQL[name]) == []


def test_hot_groups_lie_in_many_slices(split):
    orders = split.customer_orders().groupBy("customer_id")
    assert orders.agg(F.countDistinct(SLICE).alias("n")).agg(F.max("n")).first()[0] >= 5


def test_every_line_keeps_a_key_of_its_own(split, skewed):
    lines = connect(skewed).execute("SELECT count(*) FROM lineitem").fetchone()[0]
    items = split.source("order_items")
    assert items.agg(F.count("*"), F.countDistinct("id")).first()[:] == (lines, lines)
    assert split.model("fact_order_items").count() == lines


def test_one_plan_of_few_scans(split):
    for name, scans in (("purchase_sequence", 2), ("product_rank_in_category", 6)):
        plan = QUERIES[name](split)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") <= scans, name
        assert "fact_order_items" not in plan
