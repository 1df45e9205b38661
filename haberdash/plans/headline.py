"""Headline figures over the reporting layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haberdash.functions.columns import PRICE, TOTAL, growth, percent, ratio
from haberdash.functions.metrics import add_up, money
from haberdash.operators.keys import stacked
from haberdash.plans.customers import REPEAT
from haberdash.plans.logistics import center_handling, order_totals


def headline_sales(monthly: DataFrame) -> DataFrame:
    """Sales by year with growth, beside the totals of all years."""
    # Both windows run over one row per year.
    in_time, everything = Window.orderBy("order_year"), Window.partitionBy()
    revenue, profit = F.col("net_revenue"), F.col("gross_profit")
    order_value = F.col("average_order_value")
    return (
        monthly.groupBy("order_year")
        .agg(*add_up("valid_orders", "net_revenue", "gross_profit"))
        .withColumns(
            {
                "gross_margin_percent": percent(profit, revenue),
                "average_order_value": ratio(revenue, F.col("valid_orders")),
                "total_revenue": F.sum(revenue).over(everything),
                "_total_profit": F.sum(profit).over(everything),
            }
        )
        .withColumns(
            {
                "revenue_growth_percent": growth(revenue, F.lag(revenue).over(in_time)),
                "order_value_change_percent": growth(order_value, F.lag(order_value).over(in_time)),
                "total_margin_percent": percent(F.col("_total_profit"), F.col("total_revenue")),
            }
        )
        .withColumns(money("net_revenue", "gross_profit", "total_revenue"))
        .drop("_total_profit")
        .orderBy("order_year")
    )


def cart_abandonment(sessions: DataFrame) -> DataFrame:
    """Sessions that filled a cart and left, by year and (year NULL) in all."""
    sums = ("total_sessions", "cart_sessions", "purchase_sessions", "abandoned_sessions")
    return (
        sessions.groupBy("session_year")
        .agg(
            F.count("*").alias("total_sessions"),
            F.sum("cart_flag").alias("cart_sessions"),
            F.sum("purchase_flag").alias("purchase_sessions"),
            F.sum("cart_to_purchase_dropoff_flag").alias("abandoned_sessions"),
        )
        .rollup("session_year")
        .agg(*add_up(*sums))
        .withColumns(
            {
                "session_to_cart_rate": percent(F.col("cart_sessions"), F.col("total_sessions")),
                "session_conversion_rate": percent(
                    F.col("purchase_sessions"), F.col("total_sessions")
                ),
            }
        )
        .orderBy("session_year")
    )


def returning_share(yearly: DataFrame) -> DataFrame:
    """Customers who bought again in a later year, of all customers."""
    came_back = F.max(F.when(F.col("customer_type") == REPEAT, 1).otherwise(0))
    return (
        yearly.groupBy("customer_id")
        .agg(came_back.alias("_returned"))
        .agg(
            F.count("*").alias("total_customers"), F.sum("_returned").alias("returning_customers")
        )
        .withColumn(
            "returning_share_percent",
            percent(F.col("returning_customers"), F.col("total_customers")),
        )
    )


def source_concentration(customers: DataFrame) -> DataFrame:
    """The source that brings most revenue against all others together."""
    by_source = customers.groupBy("acquisition_source").agg(*add_up("net_revenue"))
    return (
        by_source.agg(
            F.max(F.struct("net_revenue", "acquisition_source")).alias("_top"),
            F.sum("net_revenue").alias("_total"),
        )
        .select(
            F.col("_top.acquisition_source").alias("top_source"),
            F.col("_top.net_revenue").alias("top_source_revenue"),
            (F.col("_total") - F.col("_top.net_revenue")).alias("other_sources_revenue"),
            percent(F.col("_top.net_revenue"), F.col("_total")).alias("top_source_share_percent"),
        )
        .withColumns(money("top_source_revenue", "other_sources_revenue"))
    )


def customers_per_age(customers: DataFrame) -> DataFrame:
    return customers.groupBy("age").agg(F.count("*").alias("total_customers")).orderBy("age")


def category_vs_average_margin(products: DataFrame) -> DataFrame:
    """Each category's margin against the unweighted average over categories."""
    margins = (
        products.groupBy("category")
        .agg(*add_up("net_revenue", "gross_profit"))
        .withColumn("gross_margin_percent", percent(F.col("gross_profit"), F.col("net_revenue")))
    )
    # The window runs over one row per category.
    line = F.avg("gross_margin_percent").over(Window.partitionBy()).cast(PRICE)
    return (
        margins.withColumn("average_category_margin_percent", line)
        .withColumn(
            "above_average_points",
            (F.col("gross_margin_percent") - F.col("average_category_margin_percent")).cast(TOTAL),
        )
        .withColumns(money("net_revenue", "gross_profit"))
        .orderBy(F.desc("net_revenue"), "category")
    )


def unsold_capital(centers: DataFrame) -> DataFrame:
    """Money bound in unsold stock, and the share of stock sold."""
    return (
        centers.agg(
            *add_up(
                "total_inventory_items",
                "sold_items",
                "unsold_items",
                "unsold_inventory_cost",
                "old_inventory_cost",
            )
        )
        .withColumn(
            "sell_through_rate_percent",
            percent(F.col("sold_items"), F.col("total_inventory_items")),
        )
        .withColumns(money("unsold_inventory_cost", "old_inventory_cost"))
    )


def order_count_trio(orders_by_center: DataFrame, centers: DataFrame) -> DataFrame:
    """Three order counts that are not interchangeable, and the rates on them.

    Orders are counted in months with valid sales, shipments over all orders, and
    assignments at known centers. Each gives a partial row; stacked and added up they make one.
    """
    names = (
        "total_orders",
        "valid_orders",
        "cancelled_orders",
        "center_assignments",
        "fulfilled_orders",
        "single_center_orders",
    )

    def partial(frame: DataFrame, **sums) -> DataFrame:
        return frame.agg(
            *((sums[n] if n in sums else F.sum(F.lit(0))).cast("bigint").alias(n) for n in names)
        )

    def counted(condition) -> Column:
        return F.count(F.when(condition, 1))

    months = (
        order_totals(orders_by_center)
        .groupBy(F.year("order_date").alias("order_year"), F.month("order_date").alias("order_month"))
        .agg(
            F.count("*").alias("all_orders"),
            counted(F.col("valid_items") > 0).alias("valid_orders"),
            counted(F.col("cancelled_items") > 0).alias("cancelled_orders"),
            counted(F.col("distribution_center_count") == 1).alias("single_center_orders"),
        )
    )
    sold = F.col("valid_orders") > 0
    parts = [
        partial(
            months,
            total_orders=F.sum(F.when(sold, F.col("all_orders"))),
            valid_orders=F.sum("valid_orders"),
            cancelled_orders=F.sum(F.when(sold, F.col("cancelled_orders"))),
            fulfilled_orders=F.sum("all_orders"),
            single_center_orders=F.sum("single_center_orders"),
        ),
        partial(center_handling(centers, orders_by_center), center_assignments=F.sum("orders_handled")),
    ]
    cancelled = F.col("cancelled_orders")
    return (
        stacked(parts)
        .agg(*add_up(*names))
        .select(
            "total_orders",
            "valid_orders",
            "center_assignments",
            "cancelled_orders",
            percent(cancelled, F.col("total_orders")).alias("cancelled_of_total_percent"),
            percent(cancelled, F.col("valid_orders")).alias("cancelled_of_valid_percent"),
            percent(F.col("single_center_orders"), F.col("fulfilled_orders")).alias(
                "single_center_share_percent"
            ),
        )
    )
