"""Reporting layer: the seven tables a dashboard reads."""

from __future__ import annotations

from pyspark.sql import DataFrame

from haberdash.plans import customers, funnel, logistics, products, sales


def sales_monthly_preview(monthly: DataFrame, rows: int = 60) -> DataFrame:
    """The first five years of months: a look at the data, so the limit is the point."""
    return (
        monthly.select("order_year", "order_month", "valid_orders", "cancelled_orders", "total_orders")
        .orderBy("order_year", "order_month")
        .limit(rows)
    )


# View name -> model and working tables it reads, builder (tables..., cutoff).
VIEWS = {
    "sales_monthly": (("fact_order_items",), sales.sales_monthly),
    "product_performance": (
        ("dim_product", "product_items", "fact_inventory"),
        products.product_performance,
    ),
    "customer_performance": (
        ("fact_order_items", "dim_customer"),
        customers.customer_performance,
    ),
    "customer_yearly": (("fact_order_items",), customers.customer_yearly),
    "session_funnel": (("sessions",), lambda stored, _: funnel.session_funnel(stored)),
    "distribution_center_performance": (
        ("dim_distribution_center", "center_orders", "fact_inventory"),
        logistics.center_performance,
    ),
    "order_fulfilment": (("center_orders",), lambda handled, _: logistics.order_fulfilment(handled)),
}
