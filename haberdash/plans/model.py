"""Star schema: three dimensions and four facts over the cleaned layer."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haberdash.functions.columns import PRICE, days_between, flag, percent
from haberdash.functions.metrics import money, ordered_before
from haberdash.operators.skew import heavy_keys, salted_join


def _stamps(prefix: str) -> list:
    """The four life-cycle moments of an order as ``order_*_at`` and as dates."""
    steps = (("created", "order"), ("shipped", "shipped"), ("delivered", "delivered"), ("returned", "returned"))
    columns = []
    for step, date in steps:
        moment = F.col(f"{prefix}{step}_at")
        columns += [moment.alias(f"order_{step}_at"), F.to_date(moment).alias(f"{date}_date")]
    return columns


def _lead_times(prefix: str) -> list:
    created = F.col(f"{prefix}created_at")
    return [
        days_between(created, F.col(f"{prefix}shipped_at")).alias("days_to_ship"),
        days_between(created, F.col(f"{prefix}delivered_at")).alias("days_to_deliver"),
    ]


def _outcome(status: str) -> list:
    return [
        flag(F.col(status) == "Returned").alias("returned_flag"),
        flag(F.col(status) == "Cancelled").alias("cancelled_flag"),
    ]


def dim_customer(users: DataFrame) -> DataFrame:
    return users.select(
        F.col("id").alias("customer_id"),
        "age",
        "gender",
        "city",
        "state",
        "country",
        F.col("traffic_source").alias("acquisition_source"),
        F.col("created_at").alias("customer_created_at"),
        F.to_date("created_at").alias("customer_created_date"),
    )


def dim_product(products: DataFrame) -> DataFrame:
    return products.select(
        F.col("id").alias("product_id"),
        F.col("name").alias("product_name"),
        "category",
        "brand",
        "department",
        "sku",
        F.col("retail_price").cast(PRICE).alias("retail_price"),
    )


def dim_distribution_center(centers: DataFrame) -> DataFrame:
    return centers.select(
        F.col("id").alias("distribution_center_id"),
        F.col("name").alias("distribution_center_name"),
        "latitude",
        "longitude",
    )


def fact_orders(orders: DataFrame) -> DataFrame:
    return orders.select(
        "order_id",
        F.col("user_id").alias("customer_id"),
        F.col("status").alias("order_status"),
        *_stamps(""),
        F.col("num_of_item").alias("item_count"),
        flag(F.col("shipped_at").isNotNull()).alias("shipped_flag"),
        flag(F.col("delivered_at").isNotNull()).alias("delivered_flag"),
        *_outcome("status"),
        *_lead_times(""),
    )


def fact_order_items(items: DataFrame, orders: DataFrame, inventory: DataFrame) -> DataFrame:
    """One row per sold item; an item without its order or stock item drops out.

    Both joins keep every item column, so nothing can be added up first: the items of
    an order or stock item with very many rows are dealt over pieces. The join by order
    comes last, so at scale the stored rows lie order by order and later groupings
    shrink inside each task.
    """
    heavy = heavy_keys(items, "inventory_item_id", "order_id")
    timed = orders.select(
        "order_id",
        *(F.col(f"{s}_at").alias(f"o_{s}_at") for s in ("created", "shipped", "delivered", "returned")),
    )
    stock = inventory.select(
        F.col("id").alias("inventory_item_id"),
        F.col("product_distribution_center_id").alias("distribution_center_id"),
        F.col("cost").cast(PRICE).alias("item_cost"),
    )
    revenue = F.col("sale_price").cast(PRICE)
    stocked = salted_join(items, stock, "inventory_item_id", heavy["inventory_item_id"], "id")
    return (
        salted_join(stocked, timed, "order_id", heavy["order_id"], "id")
        .select(
            F.col("id").alias("order_item_id"),
            "order_id",
            F.col("user_id").alias("customer_id"),
            "product_id",
            "inventory_item_id",
            "distribution_center_id",
            F.col("status").alias("item_status"),
            *(F.col(f"{s}_at").alias(f"item_{s}_at") for s in ("created", "shipped", "delivered", "returned")),
            "invalid_date_sequence_flag",
            *_stamps("o_"),
            revenue.alias("item_revenue"),
            "item_cost",
            (revenue - F.col("item_cost")).cast(PRICE).alias("gross_profit_before_returns"),
            *_outcome("status"),
            *_lead_times("o_"),
        )
    )


def fact_inventory(inventory: DataFrame) -> DataFrame:
    """``ever_sold_flag`` has no cutoff; stock reports apply their own."""
    return inventory.select(
        F.col("id").alias("inventory_item_id"),
        "product_id",
        F.col("product_distribution_center_id").alias("distribution_center_id"),
        F.col("created_at").alias("inventory_created_at"),
        F.to_date("created_at").alias("inventory_created_date"),
        F.col("sold_at").alias("inventory_sold_at"),
        F.to_date("sold_at").alias("inventory_sold_date"),
        F.col("cost").cast(PRICE).alias("inventory_cost"),
        F.col("product_retail_price").cast(PRICE).alias("product_retail_price"),
        flag(F.col("sold_at").isNotNull()).alias("ever_sold_flag"),
        days_between(F.col("created_at"), F.col("sold_at")).alias("days_to_sell"),
    )


def fact_events(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("id").alias("event_id"),
        F.col("user_id").alias("customer_id"),
        "session_id",
        "sequence_number",
        F.col("created_at").alias("event_created_at"),
        F.to_date("created_at").alias("event_date"),
        "event_type",
        "traffic_source",
        "browser",
        "uri",
    )


# What the model reads of a relation that is wider: stock items repeat the texts of their product.
READ = {
    "inventory_items": (
        "id",
        "product_id",
        "created_at",
        "sold_at",
        "cost",
        "product_retail_price",
        "product_distribution_center_id",
    ),
}

# Table name -> cleaned relations it reads, builder.
TABLES = {
    "dim_customer": (("users",), dim_customer),
    "dim_product": (("products",), dim_product),
    "dim_distribution_center": (("distribution_centers",), dim_distribution_center),
    "fact_orders": (("orders",), fact_orders),
    "fact_order_items": (("order_items", "orders", "inventory_items"), fact_order_items),
    "fact_inventory": (("inventory_items",), fact_inventory),
    "fact_events": (("events",), fact_events),
}


def flagged_revenue_share(items: DataFrame, cutoff: dt.date) -> DataFrame:
    """What the items with impossible dates weigh in revenue."""
    # The window runs over the two flag values.
    everything = Window.partitionBy()
    return (
        ordered_before(items, cutoff)
        .groupBy("invalid_date_sequence_flag")
        .agg(F.count("*").alias("total_items"), F.sum("item_revenue").alias("item_revenue"))
        .withColumn(
            "revenue_share_percent",
            percent(F.col("item_revenue"), F.sum("item_revenue").over(everything)),
        )
        .withColumns(money("item_revenue"))
    )
