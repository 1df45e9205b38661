"""Sales and stock measures, each defined once.

A cancelled item leaves every sales measure; a returned item stays in the
counts but leaves revenue and profit. Rows without a status are neither.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haberdash.functions.columns import PRICE, TOTAL, flag


def status() -> Column:
    return F.col("item_status")


def revenue() -> Column:
    return F.col("item_revenue")


def profit() -> Column:
    return F.col("gross_profit_before_returns")


def ordered_before(items: DataFrame, cutoff: dt.date) -> DataFrame:
    return items.where(F.col("order_date") < F.lit(cutoff))


def valid_sales(items: DataFrame, cutoff: dt.date) -> DataFrame:
    """Items ordered before the cutoff and not cancelled."""
    return ordered_before(items, cutoff).where(status() != "Cancelled")


def total_where(condition: Column, amount: Column) -> Column:
    """Aggregate: sum of ``amount`` over rows that meet the condition, else 0."""
    return F.sum(F.when(condition, amount).otherwise(F.lit(0).cast(PRICE)))


def count_where(condition: Column) -> Column:
    return F.sum(flag(condition))


def net_revenue() -> Column:
    return total_where(status() != "Returned", revenue()).alias("net_revenue")


def gross_profit() -> Column:
    return total_where(status() != "Returned", profit()).alias("gross_profit")


def returned_items() -> Column:
    return count_where(status() == "Returned").alias("returned_items")


def add_up(*names: str) -> list[Column]:
    """Aggregates that sum already summed columns under their own names."""
    return [F.sum(n).alias(n) for n in names]


def money(*names: str) -> dict[str, Column]:
    """Totals in their reported type, for ``withColumns``."""
    return {n: F.col(n).cast(TOTAL) for n in names}


def sold_before(cutoff: dt.date) -> Column:
    """Condition: stock sold before the cutoff (a later sale does not count)."""
    return F.col("inventory_sold_date") < F.lit(cutoff)


def unsold_at(cutoff: dt.date) -> Column:
    sold = F.col("inventory_sold_date")
    return sold.isNull() | (sold >= F.lit(cutoff))


def stocked_before(inventory: DataFrame, cutoff: dt.date) -> DataFrame:
    return inventory.where(F.col("inventory_created_date") < F.lit(cutoff))


def stock_age(cutoff: dt.date) -> Column:
    return F.datediff(F.lit(cutoff), F.col("inventory_created_date"))
