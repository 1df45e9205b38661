"""Small literal cases for each business rule."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from small import CUTOFF, at, built, clean, only, relation, sold, values

from haberdash.functions import columns as c
from haberdash.operators.numbering import SLICE
from haberdash.plans import (
    cleaned,
    customers,
    funnel,
    logistics,
    model,
    products,
    profiling,
    quality,
    relations,
    sales,
)
from haberdash.sources.warehouse import Store


# -- text, dates, rates -------------------------------------------------------------


def test_blank_text_becomes_null_and_only_spaces_are_trimmed(spark):
    frame = spark.createDataFrame([("  ",), ("",), (None,), (" a ",), ("\t",)], "t STRING")
    assert values(frame.select(c.blank_to_null(F.col("t")).alias("t")), "t") == [
        (None,),
        (None,),
        (None,),
        ("a",),
        ("\t",),
    ]


def test_country_spellings_are_unified(spark):
    users = relation(
        spark,
        "users",
        *({"id": n, "country": x} for n, x in enumerate((" España", "Deutschland ", "Brasil", "Peru", "  ", None))),
    )
    assert values(clean("users", users).orderBy("id"), "country") == [
        ("Spain",),
        ("Germany",),
        ("Brazil",),
        ("Peru",),
        (None,),
        (None,),
    ]
    assert values(cleaned.country_spellings(users), "country", "user_count") == [
        ("Brasil", 1),
        ("Deutschland", 1),
    ]


def test_days_count_midnights_and_hours_count_hour_marks(spark):
    rows = [
        (at("2023-01-01 23:50"), at("2023-01-02 00:10")),
        (at("2023-01-01 10:50"), at("2023-01-01 11:10")),
        (at("2023-01-03 00:10"), at("2023-01-01 23:50")),
        (at("2023-01-01 10:50"), None),
    ]
    frame = spark.createDataFrame(rows, "a TIMESTAMP_NTZ, b TIMESTAMP_NTZ")
    result = frame.select(
        c.days_between(F.col("a"), F.col("b")).alias("days"),
        c.hours_between(F.col("a"), F.col("b")).alias("hours"),
    )
    assert values(result, "days", "hours") == [(1, 1), (0, 1), (-2, -25), (None, None)]


@pytest.mark.parametrize(
    "part, whole, expected",
    [
        ("1", "8", "12.50"),
        ("1", "0", None),
        ("-1497", "4000", "-37.43"),
        ("1", "3", "33.33"),
        ("2", "3", "66.67"),
        ("0.01", "200", "0.01"),
    ],
)
def test_percent_rounds_half_up_and_is_null_over_zero(spark, part, whole, expected):
    frame = spark.sql(f"SELECT CAST({part} AS DECIMAL(12,2)) AS n, CAST({whole} AS DECIMAL(12,2)) AS d")
    result = only(frame.select(c.percent(F.col("n"), F.col("d")).alias("p")))["p"]
    assert result == (None if expected is None else Decimal(expected))


def test_extreme_rates_do_not_overflow(spark):
    frame = spark.sql("SELECT CAST(9999999999.99 AS DECIMAL(12,2)) AS n, CAST(0.01 AS DECIMAL(12,2)) AS d")
    row = only(frame.select(c.percent(F.col("n"), F.col("d")).alias("p"), c.ratio(F.col("n"), F.col("d")).alias("r")))
    assert row == {"p": Decimal("99999999999900.00"), "r": Decimal("999999999999.00")}


def test_age_bands(spark):
    frame = spark.createDataFrame(
        [(a,) for a in (24, 25, 34, 35, 44, 45, 54, 55, 64, 65, None, -1)], "age INT"
    )
    assert [r[0] for r in frame.select(c.age_band(F.col("age"))).collect()] == [
        "Under 25",
        "25-34",
        "25-34",
        "35-44",
        "35-44",
        "45-54",
        "45-54",
        "55-64",
        "55-64",
        "65+",
        "65+",
        "Under 25",
    ]


def test_stock_bands(spark):
    frame = spark.createDataFrame([(d,) for d in (0, 29, 30, 89, 90, 179, 180, 999)], "d INT")
    label, place = c.stock_band(F.col("d"))
    assert [tuple(r) for r in frame.select(label, place).collect()] == [
        ("Under 30 days", 1),
        ("Under 30 days", 1),
        ("30-89 days", 2),
        ("30-89 days", 2),
        ("90-179 days", 3),
        ("90-179 days", 3),
        ("180+ days", 4),
        ("180+ days", 4),
    ]


# -- profiling and keys -------------------------------------------------------------


def test_repeated_and_missing_keys(spark):
    from haberdash.operators.keys import assert_keys, duplicate_keys, key_violations

    users = relation(spark, "users", {"id": 1}, {"id": 1}, {"id": 2}, {"id": None}, {"id": None})
    assert only(duplicate_keys({"Users": (users, "id")})) == {
        "table_name": "Users",
        "duplicate_keys": 2,
    }

    assert only(key_violations({"users": (users, "id")})) == {
        "table_name": "users",
        "null_keys": 2,
        "duplicate_keys": 1,
    }
    with pytest.raises(ValueError, match="users: 2 NULL, 1 repeated"):
        assert_keys({"users": (users, "id")})
    assert_keys({"users": (users.where("id = 2"), "id")})


def test_missing_values_are_counted_per_column(spark):
    orders = relation(
        spark, "orders", {"order_id": 1, "status": "Complete"}, {"order_id": None, "num_of_item": 2}
    )
    assert only(profiling.missing(orders, order_id="order_id", status="status", item_count="num_of_item")) == {
        "total_rows": 2,
        "missing_order_id": 1,
        "missing_status": 1,
        "missing_item_count": 1,
    }


def test_average_keeps_the_fraction(spark):
    users = relation(spark, "users", {"age": 20}, {"age": 21}, {"age": None}, {"age": 21})
    assert only(profiling.value_range(users, {"age": F.col("age")})) == {
        "minimum_age": 20,
        "maximum_age": 21,
        "average_age": Decimal("20.67"),
    }


def test_padded_values_count_as_one(spark):
    users = relation(spark, "users", {"country": "Spain "}, {"country": "Spain"}, {"country": " Spain"})
    counted = profiling.frequencies(users, "country", "n")
    assert values(counted, "country", "n") == [("Spain", 2), (" Spain", 1)]


# -- relationships ------------------------------------------------------------------


def test_dangling_and_null_references_are_orphans(spark):
    tables = {
        "users": relation(spark, "users", {"id": 1}),
        "products": relation(
            spark,
            "products",
            {"id": 1, "distribution_center_id": 1},
            {"id": 2, "distribution_center_id": 9},
            {"id": 3},
        ),
        "orders": relation(
            spark, "orders", {"order_id": 1, "user_id": 1}, {"order_id": 2, "user_id": 5}, {"order_id": 3}
        ),
        "order_items": relation(
            spark,
            "order_items",
            {"id": 1, "order_id": 1, "user_id": 1, "product_id": 1, "inventory_item_id": 1},
            {"id": 2, "order_id": 8, "user_id": 8, "product_id": 8, "inventory_item_id": 8},
            {"id": 3},
        ),
        "inventory_items": relation(
            spark, "inventory_items", {"id": 1, "product_id": 1}, {"id": 2, "product_id": 7}, {"id": 3}
        ),
        "distribution_centers": relation(spark, "distribution_centers", {"id": 1}),
    }
    found = values(relations.orphan_census(tables.__getitem__), "affected_rows")
    assert found == [(2,)] * 7


def test_mismatches_against_the_parent(spark):
    orders = relation(
        spark,
        "orders",
        {"order_id": 1, "user_id": 1, "status": "Returned", "num_of_item": 2},
        {"order_id": 2, "user_id": 2, "status": None, "num_of_item": 1},
        {"order_id": 3, "user_id": 3, "status": "Complete", "num_of_item": 5},
    )
    items = relation(
        spark,
        "order_items",
        {"order_id": 1, "user_id": 1, "status": "Returned ", "inventory_item_id": 1, "product_id": 1},
        {"order_id": 1, "user_id": 9, "status": "Complete", "inventory_item_id": 2, "product_id": 1},
        {"order_id": 1, "user_id": None, "status": None, "inventory_item_id": 2, "product_id": None},
        {"order_id": 2, "user_id": 2, "status": "Complete", "inventory_item_id": 9, "product_id": 1},
    )
    stock = relation(
        spark,
        "inventory_items",
        {"id": 1, "product_id": 1, "product_distribution_center_id": 4},
        {"id": 2, "product_id": 2, "product_distribution_center_id": 4},
    )
    goods = relation(
        spark, "products", {"id": 1, "distribution_center_id": 4}, {"id": 2, "distribution_center_id": 5}
    )
    assert only(relations.mismatched_customers(items, orders))["mismatched_customer_rows"] == 1
    assert only(relations.mismatched_statuses(items, orders))["mismatched_status_rows"] == 1
    # Order 1 states 2 and has 3; order 3 has none and is not judged.
    assert only(relations.mismatched_item_counts(items, orders))["orders_with_wrong_item_count"] == 1
    assert only(relations.mismatched_products(items, stock))["mismatched_inventory_products"] == 1
    assert only(relations.mismatched_centers(stock, goods))["mismatched_distribution_centers"] == 1


# -- quality --------------------------------------------------------------------------


def test_price_and_date_rules(spark):
    items = relation(
        spark,
        "order_items",
        {"sale_price": 0.0, "created_at": at("2023-01-02"), "shipped_at": at("2023-01-01")},
        {"sale_price": -1.0, "shipped_at": at("2023-01-02"), "delivered_at": at("2023-01-01")},
        {"sale_price": 5.0, "delivered_at": at("2023-01-02"), "returned_at": at("2023-01-01")},
        {"sale_price": None},
        {"created_at": at("2023-01-01"), "delivered_at": at("2023-01-01"), "returned_at": at("2023-01-05")},
    )
    stock = relation(
        spark,
        "inventory_items",
        {"cost": 5.0, "product_retail_price": 4.0},
        {"cost": -1.0, "product_retail_price": 4.0},
        {"cost": 1.0, "product_retail_price": 0.0},
        {"created_at": at("2023-01-02"), "sold_at": at("2023-01-01")},
        {"cost": 1.0, "product_retail_price": 1.0},
    )
    source = {"order_items": items, "inventory_items": stock}.__getitem__

    def count(check):
        return only(quality.violations(source, check)).popitem()[1]

    assert count("invalid_sale_prices") == 2
    assert count("items_bad_dates") == 3
    assert count("items_shipped_before_created") == 1
    assert count("items_delivered_before_shipped") == 1
    assert count("items_returned_before_delivered") == 1
    assert count("invalid_inventory_prices") == 3
    assert count("sold_before_created") == 1
    flags = values(clean("order_items", items), "invalid_date_sequence_flag")
    assert flags == [(1,), (1,), (1,), (0,), (0,)]


def test_status_must_agree_with_dates(spark):
    done = {"shipped_at": at("2023-01-01"), "delivered_at": at("2023-01-02")}
    orders = relation(
        spark,
        "orders",
        {"status": "Shipped"},
        {"status": "Complete", "shipped_at": at("2023-01-01")},
        {"status": "Returned ", **done},
        {"status": "Processing", "returned_at": at("2023-01-01")},
        {"status": "Cancelled"},
        {"status": "Complete", **done},
        {"status": None, **done},
    )
    found = quality.violations({"orders": orders}.__getitem__, "orders_status_dates")
    assert only(found) == {"orders_with_status_date_issues": 4}


def test_worst_ship_gaps_are_ordered_and_cut(spark):
    items = relation(
        spark,
        "order_items",
        *(
            {"id": n, "created_at": at("2023-02-01"), "shipped_at": at("2023-02-01") - dt.timedelta(hours=n // 2)}
            for n in range(60)
        ),
    )
    worst = values(quality.worst_ship_gaps(items), "id", "hours_to_ship")
    assert len(worst) == 20
    assert worst[:4] == [(58, -29), (59, -29), (56, -28), (57, -28)]


def test_session_rules(spark):
    events = relation(
        spark,
        "events",
        {"session_id": "a", "sequence_number": 1, "traffic_source": "Email", "browser": "x"},
        {"session_id": "a", "sequence_number": 2, "traffic_source": None, "browser": "x"},
        {"session_id": "b", "sequence_number": 1, "traffic_source": "Email", "browser": "x"},
        {"session_id": "b", "sequence_number": 3, "traffic_source": "Email", "browser": "y"},
        {"session_id": "c", "sequence_number": 1, "traffic_source": "Email", "browser": None},
        {"session_id": "c", "sequence_number": 1, "traffic_source": "Search", "browser": None},
        {"session_id": None, "sequence_number": 7, "traffic_source": "Email", "browser": "x"},
        {"session_id": None, "sequence_number": 7, "traffic_source": "Search", "browser": "x"},
    )
    assert only(quality.inconsistent_sessions(quality.session_profile(events))).popitem()[1] == 2
    assert only(quality.session_gaps(quality.session_profile(events))).popitem()[1] == 2
    assert only(quality.duplicate_session_sequences(quality.session_profile(events))).popitem()[1] == 2


def test_scorecard_equals_single_checks(warehouse):
    card = {r.check_name: r.affected_rows for r in quality.scorecard(warehouse.source).collect()}
    assert set(card) == set(quality.RULES)
    for check in ("blank_products", "orders_status_dates", "invalid_event_sequences"):
        assert card[check] == only(quality.violations(warehouse.source, check)).popitem()[1]


# -- sales ------------------------------------------------------------------------------


def test_status_rules_for_sales(spark):
    items = sold(
        spark,
        {"order": 1, "customer": 1, "revenue": "10.00", "profit": "4.00"},
        {"order": 2, "customer": 1, "status": "Returned", "revenue": "20.00", "profit": "8.00"},
        {"order": 3, "customer": 2, "status": "Cancelled", "revenue": "30.00"},
        {"order": 4, "customer": 3, "status": None, "revenue": "40.00"},
        {"order": 5, "customer": 4, "date": "2024-01-01", "revenue": "50.00"},
    )
    assert only(sales.overall_kpis(sales.customer_orders(items, CUTOFF))) == {
        "valid_orders": 2,
        "total_customers": 1,
        "net_revenue": Decimal("10.00"),
        "gross_profit": Decimal("4.00"),
        "gross_margin_percent": Decimal("40.00"),
    }
    statuses = values(sales.item_statuses(items), "item_status", "item_count")
    assert statuses == [("Complete", 2), (None, 1), ("Cancelled", 1), ("Returned", 1)]
    lost = values(products.lost_value(items, CUTOFF), "item_status", "potential_revenue_lost")
    assert lost == [("Cancelled", Decimal("30.00")), ("Returned", Decimal("20.00"))]


def test_no_sales_give_null_totals(spark):
    items = sold(spark, {"status": "Cancelled"})
    row = only(sales.overall_kpis(sales.customer_orders(items, CUTOFF)))
    assert row["valid_orders"] == 0 and row["net_revenue"] is None
    assert row["gross_margin_percent"] is None
    orders = built("fact_orders", clean("orders", relation(spark, "orders")))
    row = only(logistics.logistics_overall(orders, CUTOFF))
    assert row["total_orders"] == 0 and row["delivery_rate_percent"] is None


def test_growth_needs_an_earlier_period_above_zero(spark):
    items = sold(
        spark,
        {"order": 1, "date": "2020-03-01", "status": "Returned"},
        {"order": 2, "date": "2021-03-01", "revenue": "10.00", "profit": "4.00"},
        {"order": 3, "date": "2022-03-01", "revenue": "5.00", "profit": "-2.00"},
    )
    growth = values(
        sales.yoy_growth(items, CUTOFF), "order_year", "revenue_growth_percent", "profit_growth_percent"
    )
    assert growth == [
        (2020, None, None),
        (2021, None, None),
        (2022, Decimal("-50.00"), Decimal("-150.00")),
    ]


def test_months_with_cancelled_items_only_are_left_out(spark):
    items = sold(
        spark,
        {"order": 1, "date": "2023-01-05"},
        {"order": 1, "date": "2023-01-05", "status": "Cancelled", "revenue": "7.00"},
        {"order": 2, "date": "2023-02-05", "status": "Cancelled"},
        {"order": 3, "date": "2023-01-09", "status": None},
    )
    row = only(sales.sales_monthly(items, CUTOFF))
    assert (row["order_year"], row["order_month"]) == (2023, 1)
    # An order can be valid and cancelled; one without a status only exists.
    assert (row["valid_orders"], row["cancelled_orders"], row["total_orders"]) == (1, 1, 2)
    assert row["cancelled_revenue_value"] == Decimal("7.00")


# -- products ------------------------------------------------------------------------------


def _goods(spark, *rows):
    return built("dim_product", clean("products", relation(spark, "products", *rows)))


def test_brandless_products_form_a_group(spark):
    goods = _goods(spark, {"id": 1, "brand": " "}, {"id": 2, "brand": None}, {"id": 3, "brand": "B "})
    items = sold(spark, *({"order": n, "product": n} for n in (1, 2, 3)))
    brands = values(products.brand_performance(products.product_items(items, CUTOFF), goods), "brand", "total_items")
    assert brands == [(None, 2), ("B", 1)]


def test_ranks_share_places_and_top_lists_break_ties_by_key(spark, tmp_path):
    goods = _goods(spark, *({"id": n, "category": "A"} for n in (1, 2, 3)))
    items = sold(
        spark,
        {"product": 1, "revenue": "10.00"},
        {"product": 2, "revenue": "10.00"},
        {"product": 3, "revenue": "0.00", "profit": "0.00"},
    )
    ranks = values(
        products.rank_in_category(products.product_items(items, CUTOFF), goods, Store(spark, str(tmp_path)).table),
        "product_id",
        "revenue_rank_in_category",
        "category_revenue_share_percent",
    )
    assert ranks == [(1, 1, Decimal("50.0000")), (2, 1, Decimal("50.0000")), (3, 2, Decimal("0.0000"))]
    top = values(products.top_products(products.product_items(items, CUTOFF), goods, rows=2), "product_id")
    assert top == [(1,), (2,)]
    thin = values(
        products.high_revenue_low_margin(products.product_items(items, CUTOFF), goods), "product_id", "gross_margin_percent"
    )
    assert thin == [(3, None), (1, Decimal("40.00")), (2, Decimal("40.00"))]


def test_rarely_sold_products_are_not_rated_by_returns(spark):
    goods = _goods(spark, {"id": 1}, {"id": 2})
    items = sold(
        spark,
        *({"product": 1, "order": n, "status": "Returned"} for n in range(9)),
        *({"product": 2, "order": n, "status": "Returned" if n else "Complete"} for n in range(10)),
    )
    rated = values(products.highest_return_rates(products.product_items(items, CUTOFF), goods), "product_id", "return_rate_percent")
    assert rated == [(2, Decimal("90.00"))]


def test_product_without_sales_or_stock_is_reported_with_labels_and_zeros(spark):
    goods = _goods(spark, {"id": 1, "retail_price": 9.5})
    stock = built("fact_inventory", clean("inventory_items", relation(spark, "inventory_items")))
    row = only(products.product_performance(
        goods, products.product_items(sold(spark, {"product": 2}), CUTOFF), stock, CUTOFF
    ))
    assert row["product_name"] == "Unknown product" and row["brand"] == "Unknown brand"
    assert row["category"] == "Unknown category" and row["department"] == "Unknown department"
    assert row["ordered_items"] == row["unsold_items"] == 0
    assert row["net_revenue"] == Decimal("0.00")
    assert row["average_unsold_age_days"] is None and row["gross_margin_percent"] is None


def test_status_less_items_are_ordered_but_not_valid(spark):
    stock = built("fact_inventory", clean("inventory_items", relation(spark, "inventory_items")))
    items = sold(spark, {"status": None}, {"status": "Complete"}, {"status": "Cancelled"})
    row = only(products.product_performance(
        _goods(spark, {"id": 1}), products.product_items(items, CUTOFF), stock, CUTOFF
    ))
    assert (row["ordered_items"], row["valid_items"], row["cancelled_items"]) == (3, 1, 1)
    assert row["cancellation_rate_percent"] == Decimal("33.33")


# -- customers -------------------------------------------------------------------------------


def test_two_meanings_of_repeat_customer(spark):
    items = sold(
        spark,
        {"customer": 1, "order": 1, "date": "2022-01-01"},
        {"customer": 1, "order": 2, "date": "2022-06-01"},
        {"customer": 2, "order": 3, "date": "2022-01-01"},
        {"customer": 3, "order": 4, "date": "2021-01-01"},
        {"customer": 3, "order": 5, "date": "2022-01-01"},
    )
    types = {r.customer_type: r.total_customers for r in customers.one_time_vs_repeat(sales.customer_orders(items, CUTOFF)).collect()}
    assert types == {"Repeat customer": 2, "One-time customer": 1}
    yearly = customers.new_vs_repeat_by_year(items, CUTOFF)
    assert values(yearly, "order_year", "customer_type", "total_customers") == [
        (2021, "New customer", 1),
        (2022, "New customer", 2),
        (2022, "Repeat customer", 1),
    ]


def test_an_order_shared_by_customers_counts_once_per_group(spark):
    people = built(
        "dim_customer",
        clean("users", relation(spark, "users", {"id": 1, "country": "Peru"}, {"id": 2, "country": "Peru"})),
    )
    items = sold(spark, {"customer": 1, "order": 1}, {"customer": 2, "order": 1}, {"customer": 9, "order": 2})
    row = only(customers.by_country(sales.customer_orders(items, CUTOFF), people))
    assert (row["total_customers"], row["valid_orders"]) == (2, 1)
    assert row["average_order_value"] == Decimal("20.00")


def test_purchase_sequence(spark):
    items = sold(
        spark,
        {"order": 2, "date": "2023-01-05"},
        {"order": 1, "date": "2023-01-05"},
        {"order": 1, "date": "2023-01-05", "status": "Returned"},
        {"order": 3, "date": "2023-02-05"},
    )
    rows = values(
        customers.purchase_sequence(sales.customer_orders(items, CUTOFF).withColumn(SLICE, F.lit(0))),
        "order_id",
        "customer_order_number",
        "days_since_previous_order",
        "order_revenue",
    )
    ten = Decimal("10.00")
    assert rows == [(1, 1, None, ten), (2, 2, 0, ten), (3, 3, 31, ten)]


# -- funnel ---------------------------------------------------------------------------------


def _events(spark, *rows):
    raw = relation(spark, "events", *({"created_at": at("2023-05-01"), **r} for r in rows))
    return built("fact_events", clean("events", raw))


def test_a_session_with_two_browsers_is_two_rows(spark):
    events = _events(
        spark,
        {"session_id": "s", "traffic_source": "Email", "browser": "x", "event_type": "product"},
        {"session_id": "s", "traffic_source": "Email", "browser": "y", "event_type": "cart"},
        {"session_id": " ", "traffic_source": "Email", "browser": "y", "event_type": "cart"},
        {"session_id": "t", "event_type": None},
        {"session_id": "u", "event_type": "purchase", "created_at": at("2024-01-01")},
    )
    sessions = funnel.session_flags(funnel.sessions(events, CUTOFF))
    assert sessions.count() == 3
    assert only(funnel.cart_without_product(sessions)) == {"cart_without_product": 1}
    assert only(funnel.purchase_without_cart(sessions)) == {"purchase_without_cart": 0}
    overall = only(funnel.funnel_overall(sessions))
    assert (overall["total_sessions"], overall["product_to_cart_rate"]) == (3, Decimal("100.00"))
    assert overall["cart_to_purchase_rate"] == Decimal("0.00")
    view = funnel.session_funnel(funnel.sessions(events, CUTOFF)).orderBy("session_id", "browser")
    assert values(view, "product_to_cart_dropoff_flag", "cart_to_purchase_dropoff_flag") == [
        (1, 0),
        (0, 1),
        (0, 0),
    ]


def test_rates_of_a_step_nobody_reached_are_null(spark):
    sessions = funnel.session_flags(funnel.sessions(_events(spark, {"session_id": "s", "event_type": "home"}), CUTOFF))
    overall = only(funnel.funnel_overall(sessions))
    assert overall["product_to_cart_rate"] is None
    assert overall["session_conversion_rate"] == Decimal("0.00")


# -- logistics --------------------------------------------------------------------------------


def _centers(spark, *rows):
    raw = relation(spark, "distribution_centers", *rows)
    return built("dim_distribution_center", clean("distribution_centers", raw))


def _stock(spark, *rows):
    raw = relation(spark, "inventory_items", *rows)
    return built("fact_inventory", clean("inventory_items", raw))


def test_items_of_one_order_are_one_assignment(spark):
    items = sold(
        spark,
        {"order": 1, "center": 1, "ship": 2, "deliver": 4},
        {"order": 1, "center": 1, "ship": 2, "deliver": 4, "status": "Returned"},
        {"order": 1, "center": 2, "ship": 2, "deliver": 4},
        {"order": 2, "center": 1, "ship": 1},
    )
    centers = _centers(spark, {"id": 1, "name": "East"}, {"id": 2, "name": "East "}, {"id": 3, "name": "West"})
    row = only(logistics.logistics_by_center(logistics.center_orders(items, CUTOFF), centers))
    assert row["orders_handled"] == 3
    assert row["average_days_to_ship"] == Decimal("1.666667")
    assert row["return_rate_percent"] == Decimal("33.33")
    fulfilment = logistics.order_fulfilment(logistics.center_orders(items, CUTOFF)).orderBy("order_id")
    assert values(fulfilment, "order_id", "distribution_center_count", "returned_flag") == [
        (1, 2, 1),
        (2, 1, 0),
    ]


def test_center_without_orders_or_stock(spark):
    centers = _centers(spark, {"id": 7, "name": "West"})
    row = only(logistics.center_performance(
        centers, logistics.center_orders(sold(spark, {}), CUTOFF), _stock(spark), CUTOFF
    ))
    assert row["orders_handled"] == row["total_inventory_items"] == 0
    assert row["net_revenue"] == Decimal("0.00")
    assert row["average_days_to_ship"] is None and row["return_rate_percent"] is None


def test_stock_sold_after_the_cutoff_is_unsold(spark):
    new, old = at("2023-12-20"), at("2023-01-01")
    stock = _stock(
        spark,
        {"id": 1, "created_at": old, "sold_at": at("2023-06-01"), "cost": 1.0, "product_retail_price": 2.0},
        {"id": 2, "created_at": old, "sold_at": at("2024-01-01"), "cost": 3.0, "product_retail_price": 5.0},
        {"id": 3, "created_at": new, "cost": 4.0, "product_retail_price": 6.0},
        {"id": 4, "created_at": at("2024-01-01"), "cost": 9.0, "product_retail_price": 9.0},
    )
    row = only(logistics.inventory_overall(stock, CUTOFF))
    assert (row["total_inventory_items"], row["sold_items"], row["unsold_items"]) == (3, 1, 2)
    assert row["unsold_inventory_cost"] == Decimal("7.00")
    assert row["unsold_retail_value"] == Decimal("11.00")
    assert values(stock.orderBy("inventory_item_id"), "ever_sold_flag") == [(1,), (1,), (0,), (0,)]
    aging = values(logistics.inventory_aging(stock, CUTOFF), "age_group", "unsold_items")
    assert aging == [("Under 30 days", 1), ("180+ days", 1)]


def test_items_without_order_or_stock_leave_the_fact(spark):
    items = relation(
        spark,
        "order_items",
        {"id": 1, "order_id": 1, "inventory_item_id": 1, "sale_price": 10.0},
        {"id": 2, "order_id": 9, "inventory_item_id": 1, "sale_price": 10.0},
        {"id": 3, "order_id": 1, "inventory_item_id": 9, "sale_price": 10.0},
        {"id": 4, "order_id": None, "inventory_item_id": None, "sale_price": 10.0},
    )
    orders = relation(
        spark, "orders", {"order_id": 1, "created_at": at("2023-01-01 23:00"), "shipped_at": at("2023-01-02 01:00")}
    )
    stock = relation(spark, "inventory_items", {"id": 1, "cost": 4.0, "product_distribution_center_id": 3})
    fact = built(
        "fact_order_items", clean("order_items", items), clean("orders", orders), clean("inventory_items", stock)
    )
    row = only(fact)
    assert (row["order_item_id"], row["distribution_center_id"], row["days_to_ship"]) == (1, 3, 1)
    assert row["gross_profit_before_returns"] == Decimal("6.00")
    assert row["days_to_deliver"] is None and row["returned_flag"] == 0


def test_flagged_revenue_share(spark):
    items = sold(spark, {"revenue": "1.00"}, {"revenue": "2.00"}).withColumn(
        "invalid_date_sequence_flag", F.when(F.col("item_revenue") > 1, 1).otherwise(0)
    )
    shares = model.flagged_revenue_share(items, CUTOFF).orderBy("invalid_date_sequence_flag")
    assert values(shares, "revenue_share_percent") == [(Decimal("33.33"),), (Decimal("66.67"),)]
