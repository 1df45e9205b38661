"""Sales and growth over time. ``items`` is the order-item fact throughout."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haberdash.functions.columns import growth, percent, ratio
from haberdash.functions.metrics import (
    add_up,
    gross_profit,
    money,
    net_revenue,
    ordered_before,
    returned_items,
    total_where,
    valid_sales,
    profit,
    revenue,
    status,
)


def year() -> Column:
    return F.year("order_date").alias("order_year")


def month() -> Column:
    return F.month("order_date").alias("order_month")


def item_statuses(items: DataFrame) -> DataFrame:
    """Items per status over the whole fact, cutoff or not."""
    return (
        items.groupBy("item_status")
        .agg(F.count("*").alias("item_count"))
        .orderBy(F.desc("item_count"), "item_status")
    )


# What reports and working tables read of the item fact.
REPORTED = (
    "order_id",
    "customer_id",
    "product_id",
    "distribution_center_id",
    "item_status",
    "order_date",
    "item_revenue",
    "gross_profit_before_returns",
    "returned_flag",
    "cancelled_flag",
    "days_to_ship",
    "days_to_deliver",
)


def reported_items(items: DataFrame, cutoff: dt.date) -> DataFrame:
    """The items that reports add up; stored, so several of them share the joins of the fact."""
    return ordered_before(items, cutoff).select(*REPORTED)


def customer_orders(items: DataFrame, cutoff: dt.date) -> DataFrame:
    """Valid sales per customer and order: the grain under the customer reports.

    One row stands for all items of an order, so the joins and distinct counts
    that follow move orders, not items, and a customer with very many items is
    first reduced inside each task.
    """
    return (
        valid_sales(items, cutoff)
        .groupBy("customer_id", "order_id")
        .agg(
            F.min("order_date").alias("order_date"),
            F.count("*").alias("total_items"),
            returned_items(),
            net_revenue(),
            gross_profit(),
        )
    )


def customers_and_orders(orders: DataFrame, *period) -> tuple[DataFrame, DataFrame]:
    """Per period, from rows per customer and order: customers with their sales, and orders.

    Two groupings instead of two distinct counts in one, which would triple the rows.
    """
    names = [p if isinstance(p, str) else "order_year" for p in period]
    sales = (
        orders.groupBy(*period, "customer_id")
        .agg(*add_up("net_revenue", "gross_profit"))
        .groupBy(*names)
        .agg(F.count("customer_id").alias("total_customers"), *add_up("net_revenue", "gross_profit"))
    )
    distinct = orders.select(*period, "order_id").distinct()
    return sales, distinct.groupBy(*names).agg(F.count("order_id").alias("valid_orders"))


def overall_kpis(orders: DataFrame) -> DataFrame:
    sold, counted = customers_and_orders(orders)
    names = ["valid_orders", "total_customers", "net_revenue", "gross_profit"]
    rows = counted.unionByName(sold, allowMissingColumns=True)  # two rows
    return (
        rows.agg(*(F.max(n).alias(n) for n in names))
        .withColumn("gross_margin_percent", percent(F.col("gross_profit"), F.col("net_revenue")))
        .withColumns(money("net_revenue", "gross_profit"))
    )


def annual_performance(orders: DataFrame) -> DataFrame:
    sold, counted = customers_and_orders(orders, year())
    names = ["order_year", "valid_orders", "total_customers", "net_revenue", "gross_profit"]
    rows = counted.unionByName(sold, allowMissingColumns=True)  # two rows per year
    return (
        rows.groupBy("order_year")
        .agg(*(F.max(n).alias(n) for n in names[1:]))
        .withColumns(money("net_revenue", "gross_profit"))
        .orderBy("order_year")
    )


def _by_period(items: DataFrame, cutoff: dt.date, *period) -> DataFrame:
    return (
        valid_sales(items, cutoff)
        .groupBy(*period)
        .agg(F.countDistinct("order_id").alias("valid_orders"), net_revenue(), gross_profit())
    )


def monthly_trend(items: DataFrame, cutoff: dt.date) -> DataFrame:
    # The window runs over one row per month.
    in_time = Window.orderBy("order_year", "order_month")
    revenue, profit = F.col("net_revenue"), F.col("gross_profit")
    return (
        _by_period(items, cutoff, year(), month())
        .withColumns(
            {
                "previous_month_revenue": F.lag("net_revenue").over(in_time),
                "previous_month_profit": F.lag("gross_profit").over(in_time),
                "cumulative_revenue": F.sum("net_revenue").over(in_time),
                "cumulative_profit": F.sum("gross_profit").over(in_time),
            }
        )
        .withColumns(
            {
                "monthly_revenue_growth_percent": growth(revenue, F.col("previous_month_revenue")),
                "monthly_profit_growth_percent": growth(profit, F.col("previous_month_profit")),
            }
        )
        .withColumns(
            money(
                "net_revenue",
                "gross_profit",
                "previous_month_revenue",
                "previous_month_profit",
                "cumulative_revenue",
                "cumulative_profit",
            )
        )
        .orderBy("order_year", "order_month")
    )


def yoy_growth(items: DataFrame, cutoff: dt.date) -> DataFrame:
    # The window runs over one row per year.
    in_time = Window.orderBy("order_year")
    return (
        valid_sales(items, cutoff)
        .groupBy(year())
        .agg(net_revenue(), gross_profit())
        .withColumns(
            {
                "revenue_growth_percent": growth(
                    F.col("net_revenue"), F.lag("net_revenue").over(in_time)
                ),
                "profit_growth_percent": growth(
                    F.col("gross_profit"), F.lag("gross_profit").over(in_time)
                ),
            }
        )
        .withColumns(money("net_revenue", "gross_profit"))
        .orderBy("order_year")
    )


def order_value_by_year(items: DataFrame, cutoff: dt.date) -> DataFrame:
    return (
        _by_period(items, cutoff, year())
        .withColumn("average_order_value", ratio(F.col("net_revenue"), F.col("valid_orders")))
        .withColumns(money("net_revenue"))
        .select("order_year", "net_revenue", "valid_orders", "average_order_value")
        .orderBy("order_year")
    )


def sales_monthly(items: DataFrame, cutoff: dt.date) -> DataFrame:
    """Months with valid sales: what was sold, returned and cancelled.

    Valid, cancelled and all orders are three distinct counts of one column.
    Per order they become flags, so items are grouped by order once; only the
    customers need a second, narrow grouping.
    """
    before = ordered_before(items, cutoff)
    cancelled = status() == "Cancelled"
    orders = before.groupBy(year(), month(), "order_id").agg(
        F.count(F.when(status() != "Cancelled", 1)).alias("valid_items"),
        F.count(F.when(status() == "Returned", 1)).alias("returned_items"),
        F.count(F.when(cancelled, 1)).alias("cancelled_items"),
        total_where(~status().isin("Returned", "Cancelled"), revenue()).alias("net_revenue"),
        total_where(~status().isin("Returned", "Cancelled"), profit()).alias("gross_profit"),
        total_where(status() == "Returned", revenue()).alias("returned_revenue_value"),
        total_where(cancelled, revenue()).alias("cancelled_revenue_value"),
    )
    months = (
        orders.groupBy("order_year", "order_month")
        .agg(
            F.count(F.when(F.col("valid_items") > 0, 1)).alias("valid_orders"),
            F.count("*").alias("total_orders"),
            F.count(F.when(F.col("cancelled_items") > 0, 1)).alias("cancelled_orders"),
            *add_up(
                "valid_items",
                "returned_items",
                "cancelled_items",
                "net_revenue",
                "gross_profit",
                "returned_revenue_value",
                "cancelled_revenue_value",
            ),
        )
        .where("valid_items > 0")
    )
    customers = (
        valid_sales(items, cutoff)
        .groupBy(year(), month())
        .agg(F.countDistinct("customer_id").alias("total_customers"))
    )
    return (
        months.join(customers, ["order_year", "order_month"])
        .withColumns(
            {
                "gross_margin_percent": percent(F.col("gross_profit"), F.col("net_revenue")),
                "average_order_value": ratio(F.col("net_revenue"), F.col("valid_orders")),
                "return_rate_percent": percent(F.col("returned_items"), F.col("valid_items")),
            }
        )
        .withColumns(
            money("net_revenue", "gross_profit", "returned_revenue_value", "cancelled_revenue_value")
        )
        .select(
            "order_year",
            "order_month",
            "valid_orders",
            "total_customers",
            "total_orders",
            "valid_items",
            "returned_items",
            "cancelled_orders",
            "cancelled_items",
            "net_revenue",
            "gross_profit",
            "returned_revenue_value",
            "cancelled_revenue_value",
            "gross_margin_percent",
            "average_order_value",
            "return_rate_percent",
        )
    )
