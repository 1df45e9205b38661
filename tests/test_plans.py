"""What the physical plans must and must not contain."""

from __future__ import annotations

import re

import pytest

from haberdash.plans import model
from haberdash.registry import QUERIES

# Windows without a partition run over one row per month, year, category or flag value.
TINY_WINDOWS = {
    "monthly_trend", "yoy_growth", "headline_sales", "flagged_revenue_share", "category_vs_average_margin",
}


def physical(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def unhinted(spark, warehouse):
    """Plans as for tables too large to broadcast."""
    warehouse.build("src")
    warehouse.build("analytics")
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.maxMetadataStringLength": "5000",
    }
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield warehouse
    for name, value in before.items():
        spark.conf.set(name, value)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"rebuild_model"}))
def test_plan_scales(unhinted, name):
    plan = physical(QUERIES[name](unhinted))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "InArrow"):
        assert node not in plan, node
    # Nothing is broadcast without a check of its size.
    assert "BroadcastExchange" not in plan
    lines = plan.splitlines()
    gathered = [
        n
        for n, line in enumerate(lines)
        if re.search(r"\bWindow \[", line)
        and any("Exchange SinglePartition" in later for later in lines[n + 1 : n + 3])
    ]
    assert not gathered or name in TINY_WINDOWS


def test_report_scans_only_its_columns_and_pushes_the_cutoff(unhinted):
    plan = physical(QUERIES["monthly_trend"](unhinted))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert {c.split(":")[0] for c in schema.split(",") if ":" in c} == {
        "order_id",
        "item_status",
        "order_date",
        "item_revenue",
        "gross_profit_before_returns",
    }
    pushed = re.search(r"PushedFilters: \[([^\]]*)\]", plan).group(1)
    assert "LessThan(order_date,2001-08-01)" in pushed


def test_top_lists_do_not_sort_everything(unhinted):
    lists = {
        "top_products": 1,
        "high_revenue_low_margin": 2,
        "highest_return_rates": 1,
        "slow_movers": 1,
        "worst_ship_gaps": 1,
        "sales_monthly_preview": 1,
        "preview_order_items": 1,
    }
    for name, count in lists.items():
        plan = physical(QUERIES[name](unhinted))
        assert plan.count("TakeOrderedAndProject") == count, name
        assert "rangepartitioning" not in plan and "CollectLimit" not in plan, name


def test_item_fact_moves_each_side_once_per_join(unhinted):
    needs, build = model.TABLES["fact_order_items"]
    plan = physical(build(*(unhinted.cleaned(n) for n in needs)))
    assert plan.count("SortMergeJoin") == 2
    assert plan.count("Exchange hashpartitioning") == 4
    # The last join leaves the stored rows grouped by order.
    assert plan.index("SortMergeJoin [order_id") < plan.index("SortMergeJoin [inventory_item_id")


def test_orders_of_a_month_are_grouped_once(unhinted):
    plan = physical(QUERIES["sales_monthly"](unhinted))
    assert "Expand" not in plan
    assert plan.count("FileScan") == 2


@pytest.mark.parametrize(
    "name", ["overall_kpis", "annual_performance", "by_country", "by_age_group", "by_gender"]
)
def test_reports_by_customer_read_the_stored_orders(unhinted, name):
    plan = physical(QUERIES[name](unhinted))
    assert "Expand" not in plan and "customer_orders" in plan and "fact_order_items" not in plan


@pytest.mark.parametrize(
    "name", ["mismatch_customer", "mismatch_status", "mismatch_product"]
)
def test_child_rows_move_once(unhinted, name):
    plan = physical(QUERIES[name](unhinted))
    assert "Expand" not in plan
    assert plan.count("Exchange hashpartitioning") == 2


@pytest.mark.parametrize("name", ["purchase_sequence", "product_rank_in_category"])
def test_numbering_reads_stored_slices(unhinted, name):
    plan = physical(QUERIES[name](unhinted))
    assert "fact_order_items" not in plan and plan.count("FileScan") <= 3
    assert plan.count("Exchange ") <= 8


def test_references_are_counted_in_one_exchange(unhinted):
    plan = physical(QUERIES["orphan_census"](unhinted))
    assert plan.count("FileScan") == 6 and "Join" not in plan
    assert plan.count("Exchange hashpartitioning") == 1
    for name in ("dup_keys", "pk_assert_model"):
        plan = physical(QUERIES[name](unhinted))
        assert plan.count("FileScan") == 7
        # The second and third move a row for each table and task.
        assert plan.count("Exchange hashpartitioning") == 3


@pytest.mark.parametrize(
    ("name", "scans", "exchanges"),
    [
        ("order_fulfilment", 1, 1),
        ("logistics_by_center", 2, 4),
        ("distribution_center_performance", 3, 4),
        ("order_count_trio", 3, 7),
        ("category_vs_average_margin", 3, 6),
        ("product_performance", 3, 4),
    ],
)
def test_reports_add_up_stored_grains(unhinted, name, scans, exchanges):
    plan = physical(QUERIES[name](unhinted))
    assert "fact_order_items" not in plan and "Subquery" not in plan
    assert plan.count("FileScan") <= scans and plan.count("Exchange ") <= exchanges


@pytest.mark.parametrize(
    "name", ["dup_session_sequence", "session_gaps", "session_multi_attr", "session_flags", "session_funnel"]
)
def test_session_reports_read_a_stored_row_per_session(unhinted, name):
    plan = physical(QUERIES[name](unhinted))
    assert "hashpartitioning" not in plan and plan.count("FileScan") == 1
    assert "session_profile" in plan or "/sessions/" in plan
