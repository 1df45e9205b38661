"""Product performance. Items are added up per product, once, before any join."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haberdash.functions.columns import OLD_STOCK_DAYS, PRICE, percent
from haberdash.functions.metrics import (
    profit,
    revenue,
    status,
    add_up,
    count_where,
    money,
    ordered_before,
    sold_before,
    stock_age,
    stocked_before,
    total_where,
    unsold_at,
)
from haberdash.operators.numbering import Keep, dense_ranks, group_totals
from haberdash.operators.sizes import sized


def product_items(items: DataFrame, cutoff: dt.date) -> DataFrame:
    """Items per product, by outcome; stored, as all reports on products add up from it."""
    returned, cancelled = status() == "Returned", status() == "Cancelled"
    kept = ~status().isin("Returned", "Cancelled")
    return (
        ordered_before(items, cutoff)
        .groupBy("product_id")
        .agg(
            F.count("*").alias("ordered_items"),
            count_where(~cancelled).alias("valid_items"),
            count_where(returned).alias("returned_items"),
            count_where(cancelled).alias("cancelled_items"),
            total_where(kept, revenue()).alias("net_revenue"),
            total_where(kept, profit()).alias("gross_profit"),
            total_where(returned, revenue()).alias("returned_revenue_value"),
            total_where(cancelled, revenue()).alias("cancelled_revenue_value"),
        )
    )


def product_sales(per_product: DataFrame) -> DataFrame:
    """Products with valid sales, and those."""
    return per_product.where("valid_items > 0").select(
        "product_id", F.col("valid_items").alias("total_items"), "returned_items", "net_revenue", "gross_profit"
    )


def _rates(frame: DataFrame) -> DataFrame:
    return frame.withColumns(
        {
            "gross_margin_percent": percent(F.col("gross_profit"), F.col("net_revenue")),
            "return_rate_percent": percent(F.col("returned_items"), F.col("total_items")),
        }
    )


def _performance_by(attribute: str, per_product: DataFrame, products: DataFrame):
    totals = (
        product_sales(per_product)
        .join(sized(products.select("product_id", attribute)), "product_id")
        .groupBy(attribute)
        .agg(*add_up("total_items", "returned_items", "net_revenue", "gross_profit"))
    )
    return (
        _rates(totals)
        .withColumns(money("net_revenue", "gross_profit"))
        .orderBy(F.desc("net_revenue"), attribute)
    )


def category_performance(per_product: DataFrame, products: DataFrame) -> DataFrame:
    return _performance_by("category", per_product, products)


def brand_performance(per_product: DataFrame, products: DataFrame) -> DataFrame:
    """Products without a brand form a group of their own."""
    return _performance_by("brand", per_product, products)


_NAMES = ("product_id", "product_name", "category", "brand")


def _named(totals: DataFrame, products: DataFrame) -> DataFrame:
    return totals.join(sized(products.select(*_NAMES)), "product_id")


def top_products(per_product: DataFrame, products: DataFrame, rows: int = 10) -> DataFrame:
    # Sort and limit stay together at the end, so Spark keeps a top list, not a full sort.
    return (
        _rates(_named(product_sales(per_product), products))
        .withColumns(money("net_revenue", "gross_profit"))
        .select(
            *_NAMES,
            "total_items",
            "net_revenue",
            "gross_profit",
            "gross_margin_percent",
            "return_rate_percent",
        )
        .orderBy(F.desc("net_revenue"), "product_id")
        .limit(rows)
    )


def rank_in_category(per_product: DataFrame, products: DataFrame, keep: Keep) -> DataFrame:
    """Each product's place in its category by revenue and by profit, and its share."""
    named = sized(products.select("product_id", "product_name", "category"))
    sold = keep(
        "product_totals",
        lambda: group_totals(
            product_sales(per_product).join(named, "product_id"), "category", "net_revenue", "_revenue"
        ),
    )
    places = {
        "net_revenue": "revenue_rank_in_category",
        "gross_profit": "profit_rank_in_category",
    }
    return (
        dense_ranks(sold, "category", places, "category_ranks", keep)
        .withColumn("category_revenue_share_percent", percent(F.col("net_revenue"), F.col("_revenue"), 4))
        .withColumns(money("net_revenue", "gross_profit"))
        .select(
            "product_id",
            "product_name",
            "category",
            "total_items",
            "net_revenue",
            "gross_profit",
            "revenue_rank_in_category",
            "profit_rank_in_category",
            "category_revenue_share_percent",
        )
        .orderBy("category", "revenue_rank_in_category", "product_id")
    )


def high_revenue_low_margin(
    per_product: DataFrame, products: DataFrame, best: int = 50, rows: int = 10
) -> DataFrame:
    """The thinnest margins among the products that sell most."""
    return (
        _named(product_sales(per_product), products)
        .withColumn("gross_margin_percent", percent(F.col("gross_profit"), F.col("net_revenue")))
        .withColumns(money("net_revenue", "gross_profit"))
        .select(*_NAMES, "net_revenue", "gross_profit", "gross_margin_percent")
        .orderBy(F.desc("net_revenue"), "product_id")
        .limit(best)
        .orderBy(F.asc_nulls_first("gross_margin_percent"), F.desc("net_revenue"), "product_id")
        .limit(rows)
    )


def highest_return_rates(
    per_product: DataFrame, products: DataFrame, at_least: int = 10, rows: int = 10
) -> DataFrame:
    often_sold = product_sales(per_product).where(F.col("total_items") >= at_least)
    return (
        _named(often_sold, products)
        .withColumn("return_rate_percent", percent(F.col("returned_items"), F.col("total_items")))
        .select(*_NAMES, "total_items", "returned_items", "return_rate_percent")
        .orderBy(F.desc("return_rate_percent"), F.desc("total_items"), "product_id")
        .limit(rows)
    )


def lost_value(items: DataFrame, cutoff: dt.date) -> DataFrame:
    """What returned and cancelled items would have brought in."""
    return (
        ordered_before(items, cutoff)
        .where(status().isin("Returned", "Cancelled"))
        .groupBy("item_status")
        .agg(
            F.count("*").alias("affected_items"),
            F.sum(revenue()).alias("potential_revenue_lost"),
            F.sum(profit()).alias("potential_gross_profit_lost"),
        )
        .withColumns(money("potential_revenue_lost", "potential_gross_profit_lost"))
        .orderBy(F.desc("potential_revenue_lost"), "item_status")
    )


def items_per_product_histogram(per_product: DataFrame) -> DataFrame:
    return (
        product_sales(per_product)
        .groupBy("total_items")
        .agg(F.count("*").alias("number_of_products"))
        .orderBy("total_items")
    )


# Labels shown in place of a missing attribute.
UNKNOWN = {
    "product_name": "Unknown product",
    "category": "Unknown category",
    "brand": "Unknown brand",
    "department": "Unknown department",
}


def stock_totals(inventory: DataFrame, key: str, cutoff: dt.date, *more) -> DataFrame:
    """Stock counts and unsold value per ``key`` at the cutoff, plus ``more`` aggregates."""
    sold, unsold, cost = sold_before(cutoff), unsold_at(cutoff), F.col("inventory_cost")
    old = unsold & (stock_age(cutoff) >= OLD_STOCK_DAYS)
    age = F.when(unsold, stock_age(cutoff).cast(PRICE))
    return (
        stocked_before(inventory, cutoff)
        .groupBy(key)
        .agg(
            F.count("*").alias("total_inventory_items"),
            count_where(sold).alias("sold_items"),
            count_where(unsold).alias("unsold_items"),
            total_where(unsold, cost).alias("unsold_inventory_cost"),
            count_where(old).alias("unsold_items_180_plus_days"),
            total_where(old, cost).alias("old_inventory_cost"),
            F.avg(age).cast(PRICE).alias("average_unsold_age_days"),
            *more,
        )
    )


def product_performance(
    products: DataFrame, sales: DataFrame, inventory: DataFrame, cutoff: dt.date
) -> DataFrame:
    """Every product with its sales and stock, zeros where it has none.

    Items and stock are each added up per product first: joined as rows they
    would multiply one another.
    """
    stock = stock_totals(inventory, "product_id", cutoff)
    counts = [c for c in (*sales.columns, *stock.columns) if c not in ("product_id", "average_unsold_age_days")]
    amounts = [c for c in counts if c.endswith(("revenue", "profit", "value", "cost"))]
    frame = (
        sized(products)
        .join(sales, "product_id", "left")
        .join(stock, "product_id", "left")
        .withColumns({c: F.coalesce(c, F.lit(label)) for c, label in UNKNOWN.items()})
        .withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counts})
        .withColumns(
            {
                "gross_margin_percent": percent(F.col("gross_profit"), F.col("net_revenue")),
                "return_rate_percent": percent(F.col("returned_items"), F.col("valid_items")),
                "cancellation_rate_percent": percent(F.col("cancelled_items"), F.col("ordered_items")),
                "sell_through_rate_percent": percent(F.col("sold_items"), F.col("total_inventory_items")),
            }
        )
        .withColumns(money(*amounts))
    )
    return frame.select(
        "product_id",
        *UNKNOWN,
        "retail_price",
        *counts,
        "average_unsold_age_days",
        "gross_margin_percent",
        "return_rate_percent",
        "cancellation_rate_percent",
        "sell_through_rate_percent",
    )
