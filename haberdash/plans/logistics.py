"""Shipping, delivery and stock. Order dates, not item dates, drive lead times."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haberdash.functions.columns import (
    OLD_STOCK_DAYS,
    PRICE,
    average,
    flag,
    mean,
    percent,
    stock_band,
)
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
from haberdash.operators.sizes import sized
from haberdash.plans.products import stock_totals


def _outcome_rates() -> dict:
    return {
        f"{rate}_rate_percent": percent(F.sum(f"{name}_flag"), F.count("*"))
        for rate, name in (("delivery", "delivered"), ("return", "returned"), ("cancellation", "cancelled"))
    }


def _lead_time_averages() -> list:
    return [
        average(F.col("days_to_ship")).alias("average_days_to_ship"),
        average(F.col("days_to_deliver")).alias("average_days_to_deliver"),
    ]


def logistics_overall(orders: DataFrame, cutoff: dt.date) -> DataFrame:
    return ordered_before(orders, cutoff).agg(
        F.count("*").alias("total_orders"),
        *(
            F.sum(f"{step}_flag").alias(f"{step}_orders")
            for step in ("shipped", "delivered", "returned", "cancelled")
        ),
        *_lead_time_averages(),
        *(rate.alias(name) for name, rate in _outcome_rates().items()),
    )


def logistics_by_year(orders: DataFrame, cutoff: dt.date) -> DataFrame:
    return (
        ordered_before(orders, cutoff)
        .groupBy(F.year("order_date").alias("order_year"))
        .agg(
            F.count("*").alias("total_orders"),
            *_lead_time_averages(),
            *(rate.alias(name) for name, rate in _outcome_rates().items()),
        )
        .orderBy("order_year")
    )


def center_orders(items: DataFrame, cutoff: dt.date) -> DataFrame:
    """One row per order and center that handled it: several items make one assignment.

    Stored, as all reports on centers and on whole orders add up from it.
    """
    kept = ~status().isin("Returned", "Cancelled")
    return (
        ordered_before(items, cutoff)
        .groupBy("distribution_center_id", "order_id")
        .agg(
            F.max("order_date").alias("order_date"),
            F.max("days_to_ship").alias("days_to_ship"),
            F.max("days_to_deliver").alias("days_to_deliver"),
            F.max(flag(F.col("days_to_deliver").isNotNull())).alias("delivered_flag"),
            F.max("returned_flag").alias("returned_flag"),
            F.max("cancelled_flag").alias("cancelled_flag"),
            F.count(F.when(status() != "Cancelled", 1)).alias("valid_items"),
            F.count(F.when(status() == "Cancelled", 1)).alias("cancelled_items"),
            total_where(kept, revenue()).alias("net_revenue"),
            total_where(kept, profit()).alias("gross_profit"),
        )
    )


def logistics_by_center(orders_by_center: DataFrame, centers: DataFrame) -> DataFrame:
    """Per center name; centers that share a name are one row."""
    sums = {
        "orders_handled": F.count("*"),
        "_ship_days": F.sum("days_to_ship"),
        "_shipped": F.count("days_to_ship"),
        "_deliver_days": F.sum("days_to_deliver"),
        "_delivered": F.count("days_to_deliver"),
        "_returned": F.sum("returned_flag"),
        "_cancelled": F.sum("cancelled_flag"),
    }
    handled = F.col("orders_handled")
    return (
        orders_by_center.groupBy("distribution_center_id")
        .agg(*(total.alias(name) for name, total in sums.items()))
        .join(sized(centers), "distribution_center_id")
        .groupBy("distribution_center_name")
        .agg(*add_up(*sums))
        .select(
            "distribution_center_name",
            "orders_handled",
            mean(F.col("_ship_days"), F.col("_shipped")).alias("average_days_to_ship"),
            mean(F.col("_deliver_days"), F.col("_delivered")).alias("average_days_to_deliver"),
            percent(F.col("_returned"), handled).alias("return_rate_percent"),
            percent(F.col("_cancelled"), handled).alias("cancellation_rate_percent"),
        )
        .orderBy(F.desc("orders_handled"), "distribution_center_name")
    )


def _stock_status(inventory: DataFrame, cutoff: dt.date, *by: str) -> DataFrame:
    sold = F.coalesce(sold_before(cutoff), F.lit(False))
    return (
        stocked_before(inventory, cutoff)
        .groupBy(*by)
        .agg(
            F.count("*").alias("total_inventory_items"),
            count_where(sold).alias("sold_items"),
            total_where(~sold, F.col("inventory_cost")).alias("unsold_inventory_cost"),
            total_where(~sold, F.col("product_retail_price")).alias("unsold_retail_value"),
        )
    )


def _stock_report(totals: DataFrame, *by: str) -> DataFrame:
    stocked, sold = F.col("total_inventory_items"), F.col("sold_items")
    return totals.withColumns(money("unsold_inventory_cost", "unsold_retail_value")).select(
        *by,
        stocked,
        sold,
        (stocked - sold).alias("unsold_items"),
        percent(sold, stocked).alias("sell_through_rate_percent"),
        "unsold_inventory_cost",
        "unsold_retail_value",
    )


def inventory_overall(inventory: DataFrame, cutoff: dt.date) -> DataFrame:
    return _stock_report(_stock_status(inventory, cutoff))


def inventory_by_center(inventory: DataFrame, centers: DataFrame, cutoff: dt.date) -> DataFrame:
    name = "distribution_center_name"
    totals = (
        _stock_status(inventory, cutoff, "distribution_center_id")
        .join(sized(centers), "distribution_center_id")
        .groupBy(name)
        .agg(
            *add_up(
                "total_inventory_items", "sold_items", "unsold_inventory_cost", "unsold_retail_value"
            )
        )
    )
    return _stock_report(totals, name).orderBy(F.desc("unsold_inventory_cost"), name)


def _unsold(inventory: DataFrame, cutoff: dt.date) -> DataFrame:
    return (
        stocked_before(inventory, cutoff)
        .where(unsold_at(cutoff))
        .withColumn("inventory_age_days", stock_age(cutoff))
    )


def inventory_aging(inventory: DataFrame, cutoff: dt.date) -> DataFrame:
    label, position = stock_band(F.col("inventory_age_days"))
    return (
        _unsold(inventory, cutoff)
        .groupBy(label.alias("age_group"), position.alias("age_order"))
        .agg(F.count("*").alias("unsold_items"), F.sum("inventory_cost").alias("unsold_inventory_cost"))
        .withColumns(money("unsold_inventory_cost"))
        .orderBy("age_order")
        .select("age_group", "unsold_items", "unsold_inventory_cost")
    )


def slow_movers(
    inventory: DataFrame, products: DataFrame, cutoff: dt.date, rows: int = 10
) -> DataFrame:
    """Products with the most money in old unsold stock."""
    return (
        _unsold(inventory, cutoff)
        .where(F.col("inventory_age_days") >= OLD_STOCK_DAYS)
        .groupBy("product_id")
        .agg(
            F.count("*").alias("unsold_items"),
            F.sum("inventory_cost").alias("unsold_inventory_cost"),
            average(F.col("inventory_age_days")).alias("average_inventory_age_days"),
        )
        .join(sized(products.select("product_id", "product_name", "category", "brand")), "product_id")
        .withColumns(money("unsold_inventory_cost"))
        .select(
            "product_id",
            "product_name",
            "category",
            "brand",
            "unsold_items",
            "unsold_inventory_cost",
            "average_inventory_age_days",
        )
        .orderBy(F.desc("unsold_inventory_cost"), "product_id")
        .limit(rows)
    )


def inventory_by_year(inventory: DataFrame, cutoff: dt.date) -> DataFrame:
    return (
        stocked_before(inventory, cutoff)
        .groupBy(F.year("inventory_created_date").alias("inventory_year"))
        .agg(F.count("*").alias("total_items"), count_where(sold_before(cutoff)).alias("sold_items"))
        .withColumn("unsold_items", F.col("total_items") - F.col("sold_items"))
        .orderBy("inventory_year")
    )


def _zeros(frame: DataFrame, totals: DataFrame) -> DataFrame:
    """``frame`` with zero for the counts and sums of ``totals`` it lacks; averages stay NULL."""
    names = [
        c
        for c in totals.columns
        if c != "distribution_center_id" and not c.startswith("average_")
    ]
    return frame.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in names})


def center_handling(centers: DataFrame, orders_by_center: DataFrame) -> DataFrame:
    """Every center with the orders it handled, zeros where it has none."""
    handled = orders_by_center.groupBy("distribution_center_id").agg(
        F.count("*").alias("orders_handled"),
        *(
            F.sum(f"{step}_flag").alias(f"{step}_orders")
            for step in ("delivered", "returned", "cancelled")
        ),
        *_lead_time_averages(),
        *add_up("net_revenue", "gross_profit"),
    )
    return _zeros(sized(centers).join(handled, "distribution_center_id", "left"), handled)


def center_performance(
    centers: DataFrame, orders_by_center: DataFrame, inventory: DataFrame, cutoff: dt.date
) -> DataFrame:
    """Every center with its orders and stock, zeros where it has none."""
    handling = center_handling(centers, orders_by_center)
    days_to_sell = F.when(sold_before(cutoff), F.col("days_to_sell").cast(PRICE))
    stock = stock_totals(
        inventory,
        "distribution_center_id",
        cutoff,
        F.avg(days_to_sell).cast(PRICE).alias("average_days_to_sell"),
    )
    total = F.col("orders_handled")
    return (
        _zeros(handling.join(stock, "distribution_center_id", "left"), stock)
        .withColumns(
            {
                "delivered_order_share_percent": percent(F.col("delivered_orders"), total),
                "return_rate_percent": percent(F.col("returned_orders"), total),
                "cancellation_rate_percent": percent(F.col("cancelled_orders"), total),
                "sell_through_rate_percent": percent(
                    F.col("sold_items"), F.col("total_inventory_items")
                ),
            }
        )
        .withColumns(
            money("net_revenue", "gross_profit", "unsold_inventory_cost", "old_inventory_cost")
        )
        .select(
            *centers.columns,
            "orders_handled",
            "delivered_orders",
            "returned_orders",
            "cancelled_orders",
            "average_days_to_ship",
            "average_days_to_deliver",
            "delivered_order_share_percent",
            "return_rate_percent",
            "cancellation_rate_percent",
            "net_revenue",
            "gross_profit",
            "total_inventory_items",
            "sold_items",
            "unsold_items",
            "sell_through_rate_percent",
            "unsold_inventory_cost",
            "unsold_items_180_plus_days",
            "old_inventory_cost",
            "average_days_to_sell",
            "average_unsold_age_days",
        )
    )


def order_totals(orders_by_center: DataFrame) -> DataFrame:
    """Per order: centers, lead times, outcome and items; a center is one row, so counting rows is enough."""
    return orders_by_center.groupBy("order_id").agg(
        F.count("distribution_center_id").alias("distribution_center_count"),
        *(
            F.max(name).alias(name)
            for name in ("order_date", "days_to_ship", "days_to_deliver", "returned_flag", "cancelled_flag")
        ),
        *add_up("valid_items", "cancelled_items"),
    )


def order_fulfilment(orders_by_center: DataFrame) -> DataFrame:
    """Per order: how many centers it ships from, lead times and outcome."""
    return order_totals(orders_by_center).select(
        "order_id",
        "distribution_center_count",
        "days_to_ship",
        "days_to_deliver",
        "returned_flag",
        "cancelled_flag",
    )
