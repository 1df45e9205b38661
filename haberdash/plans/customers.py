"""Customer value, loyalty and demographics.

Everything here starts from one row per customer and order, so a customer with
very many items weighs no more than their orders.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haberdash.functions.columns import age_band, days_between, percent, ratio
from haberdash.functions.metrics import add_up, gross_profit, money, net_revenue, valid_sales
from haberdash.operators.numbering import SLICE, numbered
from haberdash.operators.sizes import sized
from haberdash.plans.sales import customer_orders, customers_and_orders, year


# Customer types.
ONE_TIME, NEW, REPEAT = "One-time customer", "New customer", "Repeat customer"


# Keys and order of a customer's purchases.
ORDER_OF_PURCHASES = (("customer_id",), ("order_date", "order_id"))


def loyalty(valid_orders: Column) -> Column:
    """By orders in total: one, or more."""
    return F.when(valid_orders == 1, ONE_TIME).otherwise(REPEAT)


def standing(year: Column, first_year: Column) -> Column:
    """By year: the customer's first, or a later one."""
    return F.when(year == first_year, NEW).otherwise(REPEAT)


def customer_totals(orders: DataFrame) -> DataFrame:
    return (
        orders.groupBy("customer_id")
        .agg(
            F.count("*").alias("valid_orders"),
            F.min("order_date").alias("first_order_date"),
            F.max("order_date").alias("last_order_date"),
            *add_up("total_items", "returned_items", "net_revenue", "gross_profit"),
        )
    )


def one_time_vs_repeat(orders: DataFrame) -> DataFrame:
    return (
        customer_totals(orders)
        .groupBy(loyalty(F.col("valid_orders")).alias("customer_type"))
        .agg(
            F.count("*").alias("total_customers"),
            *add_up("valid_orders", "net_revenue", "gross_profit"),
        )
        .withColumns(
            {
                "average_orders_per_customer": ratio(F.col("valid_orders"), F.col("total_customers")),
                "revenue_per_customer": ratio(F.col("net_revenue"), F.col("total_customers")),
            }
        )
        .withColumns(money("net_revenue", "gross_profit"))
        .orderBy(F.desc("net_revenue"))
    )


def customer_yearly(items: DataFrame, cutoff: dt.date) -> DataFrame:
    """Each customer's years, the first marked as new.

    The window sees one row per customer and year, a handful at most.
    """
    years = Window.partitionBy("customer_id")
    return (
        valid_sales(items, cutoff)
        .groupBy("customer_id", year())
        .agg(F.countDistinct("order_id").alias("valid_orders"), net_revenue(), gross_profit())
        .withColumn("customer_type", standing(F.col("order_year"), F.min("order_year").over(years)))
        .where(F.col("customer_id").isNotNull())
        .withColumns(money("net_revenue", "gross_profit"))
        .select(
            "order_year", "customer_id", "customer_type", "valid_orders", "net_revenue", "gross_profit"
        )
    )


def new_vs_repeat_by_year(items: DataFrame, cutoff: dt.date) -> DataFrame:
    return (
        customer_yearly(items, cutoff)
        .groupBy("order_year", "customer_type")
        .agg(
            F.count("*").alias("total_customers"),
            *add_up("valid_orders", "net_revenue", "gross_profit"),
        )
        .withColumns(money("net_revenue", "gross_profit"))
        .orderBy("order_year", "customer_type")
    )


def order_frequency(orders: DataFrame) -> DataFrame:
    return (
        orders.groupBy("customer_id")
        .agg(F.count("*").alias("valid_orders"))
        .groupBy("valid_orders")
        .agg(F.count("*").alias("number_of_customers"))
        .orderBy("valid_orders")
    )


def _grouped(orders: DataFrame, customers: DataFrame, group: Column, name: str) -> DataFrame:
    """Customers, orders and sales per group; an order can span customers, so both are distinct."""
    placed = orders.join(sized(customers.select("customer_id", group.alias(name))), "customer_id")
    sold, counted = customers_and_orders(placed, name)
    rows = counted.unionByName(sold, allowMissingColumns=True)  # two rows per group
    names = ["total_customers", "valid_orders", "net_revenue", "gross_profit"]
    return rows.groupBy(name).agg(*(F.max(n).alias(n) for n in names))


def _valued(grouped: DataFrame, name: str) -> DataFrame:
    return (
        grouped.withColumns(
            {
                "revenue_per_customer": ratio(F.col("net_revenue"), F.col("total_customers")),
                "average_order_value": ratio(F.col("net_revenue"), F.col("valid_orders")),
            }
        )
        .withColumns(money("net_revenue", "gross_profit"))
        .orderBy(F.desc("net_revenue"), name)
    )


def by_country(orders: DataFrame, customers: DataFrame) -> DataFrame:
    return _valued(_grouped(orders, customers, F.col("country"), "country"), "country")


def by_acquisition_source(orders: DataFrame, customers: DataFrame) -> DataFrame:
    name = "acquisition_source"
    return _valued(_grouped(orders, customers, F.col(name), name), name)


def by_age_group(orders: DataFrame, customers: DataFrame) -> DataFrame:
    return (
        _grouped(orders, customers, age_band(F.col("age")), "age_group")
        .withColumns(money("net_revenue", "gross_profit"))
        .orderBy(F.desc("net_revenue"), "age_group")
    )


def by_gender(orders: DataFrame, customers: DataFrame) -> DataFrame:
    return (
        _grouped(orders, customers, F.col("gender"), "gender")
        .withColumns(money("net_revenue", "gross_profit"))
        .orderBy(F.desc("net_revenue"), "gender")
    )


def purchase_sequence(orders: DataFrame) -> DataFrame:
    """Each customer's orders in time: number, date before and days since.

    ``orders``: stored slices of rows per customer and order.
    """
    rows = orders.select(
        "customer_id", "order_id", "order_date", F.col("net_revenue").alias("order_revenue"), SLICE
    )
    sequence = numbered(
        rows,
        *ORDER_OF_PURCHASES,
        position="customer_order_number",
        previous=("order_date", "previous_order_date"),
    )
    return (
        sequence.withColumn(
            "days_since_previous_order",
            days_between(F.col("previous_order_date"), F.col("order_date")),
        )
        .withColumns(money("order_revenue"))
        .select(
            "customer_id",
            "order_id",
            "order_date",
            "customer_order_number",
            "previous_order_date",
            "days_since_previous_order",
            "order_revenue",
        )
        .orderBy("customer_id", "customer_order_number")
    )


def customer_performance(items: DataFrame, customers: DataFrame, cutoff: dt.date) -> DataFrame:
    """One row per customer with valid sales."""
    attributes = customers.select(
        "customer_id", "age", "gender", "city", "state", "country", "acquisition_source"
    )
    return (
        customer_totals(customer_orders(items, cutoff))
        .join(sized(attributes), "customer_id")
        .withColumns(
            {
                "age_group": age_band(F.col("age")),
                "customer_type": loyalty(F.col("valid_orders")),
                "average_order_value": ratio(F.col("net_revenue"), F.col("valid_orders")),
                "return_rate_percent": percent(F.col("returned_items"), F.col("total_items")),
            }
        )
        .withColumns(money("net_revenue", "gross_profit"))
        .select(
            *attributes.columns,
            "age_group",
            "customer_type",
            "valid_orders",
            "total_items",
            "returned_items",
            "first_order_date",
            "last_order_date",
            "net_revenue",
            "gross_profit",
            "average_order_value",
            "return_rate_percent",
        )
    )
