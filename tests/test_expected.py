"""Known figures at scale 0.01, and sums that must agree between reports."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F
from small import only, values

from haberdash.registry import QUERIES


def run(warehouse, name):
    return QUERIES[name](warehouse)


def single(warehouse, name):
    return only(run(warehouse, name)).popitem()[1]


def test_row_counts(warehouse):
    counts = dict(values(run(warehouse, "row_counts_src"), "table_name", "row_count"))
    assert counts == {
        "Users": 1500,
        "Products": 2000,
        "Orders": 15000,
        "Order_items": 60000,
        "Inventory_items": 80000,
        "Distribution_centers": 100,
        "Events": 10000,
    }
    assert warehouse.model("fact_order_items").count() == 60000


def test_item_statuses(warehouse):
    assert dict(values(run(warehouse, "item_statuses"), "item_status", "item_count")) == {
        "Cancelled": 8238,
        "Complete": 8915,
        "Processing": 12220,
        "Returned": 10887,
        "Shipped": 19620,
        None: 120,
    }


def test_sales_figures(warehouse):
    kpis = only(run(warehouse, "overall_kpis"))
    assert (kpis["valid_orders"], kpis["total_customers"]) == (12699, 1500)
    assert kpis["net_revenue"] == Decimal("2159856807.58")
    assert kpis["gross_profit"] == Decimal("1088867123.00")
    years = [tuple(r) for r in run(warehouse, "annual_performance").collect()]
    assert years[0] == (1995, 1925, 1077, Decimal("329255040.77"), Decimal("164862554.35"))
    assert years[-1] == (2001, 1106, 797, Decimal("177120317.02"), Decimal("89022745.61"))
    values_by_year = dict(values(run(warehouse, "aov_by_year"), "order_year", "average_order_value"))
    assert values_by_year[1995] == Decimal("171041.58")
    assert values_by_year[2001] == Decimal("160144.95")
    assert run(warehouse, "monthly_trend").count() == 79
    assert run(warehouse, "product_rank_in_category").count() == 2000
    assert run(warehouse, "purchase_sequence").count() == 12699


def test_product_funnel_and_stock_figures(warehouse):
    economy = only(run(warehouse, "category_performance").where("category = 'ECONOMY'"))
    assert economy["total_items"] == 8030
    assert economy["return_rate_percent"] == Decimal("21.49")
    assert economy["gross_margin_percent"] == Decimal("50.69")
    email = only(run(warehouse, "funnel_by_source").where("traffic_source = 'Email'"))
    assert email["total_sessions"] == 1285
    assert email["product_to_cart_rate"] == Decimal("95.38")
    assert email["cart_to_purchase_rate"] == Decimal("100.40")
    stock = only(run(warehouse, "inventory_overall"))
    assert (stock["total_inventory_items"], stock["sold_items"]) == (79649, 59990)
    assert values(run(warehouse, "inventory_aging"), "unsold_items") == [(452,), (929,), (1381,), (16897,)]


def test_check_figures(warehouse):
    expected = {
        "blank_orders": 31,
        "invalid_ages": 4,
        "invalid_product_prices": 20,
        "invalid_item_counts": 2143,
        "invalid_event_sequences": 33,
        "blank_products": 50,
        "items_shipped_before_created": 19194,
        "items_delivered_before_shipped": 4932,
        "items_returned_before_delivered": 0,
        "items_bad_dates": 24126,
        "items_status_dates": 12014,
        "dup_session_sequence": 4,
        "session_gaps": 61,
        "session_multi_attr": 90,
        "mismatch_status": 4349,
        "mismatch_item_count": 12891,
        "mismatch_center": 77376,
    }
    assert {name: single(warehouse, name) for name in expected} == expected
    single_center = run(warehouse, "order_fulfilment").where("distribution_center_count = 1")
    assert single_center.count() == 1137


def test_reports_agree_with_analyses(warehouse):
    kpis = only(run(warehouse, "overall_kpis"))
    revenue = F.sum("net_revenue").cast("decimal(38,2)").alias("net_revenue")
    for report in ("sales_monthly", "product_performance", "customer_performance", "customer_yearly"):
        assert only(warehouse.report(report).agg(revenue))["net_revenue"] == kpis["net_revenue"], report
    assert only(warehouse.report("sales_monthly").agg(F.sum("valid_orders").alias("n")))["n"] == 12699
    unsold = only(run(warehouse, "inventory_overall"))["unsold_items"]
    assert only(run(warehouse, "inventory_aging").agg(F.sum("unsold_items").alias("n")))["n"] == unsold
    by_product = warehouse.report("product_performance").agg(F.sum("unsold_items").alias("n"))
    assert only(by_product)["n"] == unsold
    sessions = only(run(warehouse, "funnel_overall"))["total_sessions"]
    assert warehouse.report("session_funnel").count() == sessions
    pairs = run(warehouse, "logistics_by_center").agg(F.sum("orders_handled").alias("n"))
    assert only(pairs)["n"] == only(run(warehouse, "order_count_trio"))["center_assignments"]
