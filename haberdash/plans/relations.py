"""Relationship checks between the raw relations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haberdash.functions.columns import unpadded
from haberdash.operators.keys import Reference, mismatches, orphans
from haberdash.operators.sizes import sized

# Issue label. Then child relation, reference, parent relation, parent key.
REFERENCES = (
    Reference("Orders without users", "orders", "user_id", "users", "id"),
    Reference("Order items without orders", "order_items", "order_id", "orders", "order_id"),
    Reference("Order items without users", "order_items", "user_id", "users", "id"),
    Reference("Order items without products", "order_items", "product_id", "products", "id"),
    Reference("Order items without inventory items", "order_items", "inventory_item_id", "inventory_items", "id"),
    Reference("Products without distribution centers", "products", "distribution_center_id", "distribution_centers", "id"),
    Reference("Inventory items without products", "inventory_items", "product_id", "products", "id"),
)


def orphan_census(source: Callable[[str], DataFrame]) -> DataFrame:
    """Rows per foreign key that point nowhere; a NULL reference counts."""
    return orphans(source, REFERENCES, "potential_issue")


def mismatched_customers(items: DataFrame, orders: DataFrame) -> DataFrame:
    return mismatches(
        items, "order_id", F.col("user_id"), orders, "order_id", F.col("user_id"),
        "mismatched_customer_rows",
    )


def mismatched_statuses(items: DataFrame, orders: DataFrame) -> DataFrame:
    status = unpadded(F.col("status"))
    return mismatches(
        items, "order_id", status, orders, "order_id", status, "mismatched_status_rows"
    )


def mismatched_item_counts(items: DataFrame, orders: DataFrame) -> DataFrame:
    """Orders whose stated size is not their number of items; empty orders are not judged."""
    actual = items.groupBy("order_id").agg(F.count("*").alias("actual_items"))
    return (
        sized(orders.select("order_id", "num_of_item"))
        .join(actual, "order_id")
        .where(F.col("num_of_item") != F.col("actual_items"))
        .agg(F.count("*").alias("orders_with_wrong_item_count"))
    )


def mismatched_products(items: DataFrame, inventory: DataFrame) -> DataFrame:
    return mismatches(
        items, "inventory_item_id", F.col("product_id"), inventory, "id", F.col("product_id"),
        "mismatched_inventory_products",
    )


def mismatched_centers(inventory: DataFrame, products: DataFrame) -> DataFrame:
    return mismatches(
        inventory, "product_id", F.col("product_distribution_center_id"),
        products, "id", F.col("distribution_center_id"),
        "mismatched_distribution_centers", repeated=True,
    )
