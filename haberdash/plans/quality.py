"""Data-quality checks on the raw relations.

Row rules are conditions, stated once: each runs alone as a pushed-down filter
and count, or all rules of a relation run together in one pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haberdash.functions.columns import blank_to_null, hours_between, unpadded
from haberdash.functions.metrics import count_where
from haberdash.operators.keys import stacked
from haberdash.plans.cleaned import impossible_dates


def blank(*names: str) -> Column:
    """Condition: one of the columns is NULL or only blanks."""
    condition = F.lit(False)
    for name in names:
        condition = condition | blank_to_null(F.col(name)).isNull()
    return condition


def bad_prices(cost: str, retail: str) -> Column:
    return (F.col(cost) < 0) | (F.col(retail) <= 0) | (F.col(cost) > F.col(retail))


def status_contradicts_dates() -> Column:
    """Condition: a date the status calls for is absent, or one it rules out is set."""
    status = unpadded(F.col("status"))
    steps = ("shipped_at", "delivered_at", "returned_at")
    reached = {"Shipped": 1, "Complete": 2, "Returned": 3}
    condition = F.lit(False)
    for name, count in reached.items():
        absent = F.lit(False)
        for step in steps[:count]:
            absent = absent | F.col(step).isNull()
        condition = condition | ((status == name) & absent)
    present = F.lit(False)
    for step in steps:
        present = present | F.col(step).isNotNull()
    return condition | (status.isin("Processing", "Cancelled") & present)


def _before(later: str, earlier: str) -> Callable[[], Column]:
    """Condition: the step ``later`` is dated before the step it follows."""
    return lambda: F.col(later) < F.col(earlier)


def _not_positive(name: str) -> Callable[[], Column]:
    return lambda: F.col(name) <= 0


# Relation -> check -> output column, condition of an offending row.
_RULES: dict[str, dict[str, tuple[str, Callable[[], Column]]]] = {
    "users": {
        "blank_users": ("users_with_blank_dimensions", lambda: blank("country", "traffic_source")),
        "invalid_ages": ("invalid_ages", lambda: (F.col("age") < 0) | (F.col("age") > 120)),
    },
    "products": {
        "blank_products": (
            "products_with_blank_dimensions",
            lambda: blank("category", "brand", "department"),
        ),
        "invalid_product_prices": (
            "products_with_invalid_prices",
            lambda: bad_prices("cost", "retail_price"),
        ),
    },
    "orders": {
        "blank_orders": ("orders_with_blank_status", lambda: blank("status")),
        "invalid_item_counts": ("invalid_item_counts", _not_positive("num_of_item")),
        "orders_bad_dates": ("orders_with_invalid_date_sequence", impossible_dates),
        "orders_status_dates": ("orders_with_status_date_issues", status_contradicts_dates),
    },
    "order_items": {
        "invalid_sale_prices": ("invalid_sale_prices", _not_positive("sale_price")),
        "items_bad_dates": ("order_items_with_invalid_date_sequence", impossible_dates),
        "items_shipped_before_created": (
            "shipped_before_created",
            _before("shipped_at", "created_at"),
        ),
        "items_delivered_before_shipped": (
            "delivered_before_shipped",
            _before("delivered_at", "shipped_at"),
        ),
        "items_returned_before_delivered": (
            "returned_before_delivered",
            _before("returned_at", "delivered_at"),
        ),
        "items_status_dates": ("order_items_with_status_date_issues", status_contradicts_dates),
    },
    "inventory_items": {
        "invalid_inventory_prices": (
            "inventory_with_invalid_prices",
            lambda: bad_prices("cost", "product_retail_price"),
        ),
        "sold_before_created": ("inventory_sold_before_creation", _before("sold_at", "created_at")),
    },
    "events": {
        "blank_events": (
            "events_with_blank_dimensions",
            lambda: blank("session_id", "event_type", "traffic_source", "browser"),
        ),
        "invalid_event_sequences": ("invalid_event_sequences", _not_positive("sequence_number")),
    },
}

# Check -> relation, output column, condition.
RULES = {
    check: (relation, *rule) for relation, rules in _RULES.items() for check, rule in rules.items()
}


def violations(source: Callable[[str], DataFrame], check: str) -> DataFrame:
    """One row: how many rows break the rule."""
    relation, alias, condition = RULES[check]
    return source(relation).where(condition()).agg(F.count("*").alias(alias))


def scorecard(source: Callable[[str], DataFrame]) -> DataFrame:
    """Every row rule with its count, in one pass over each relation."""
    reports = []
    for relation, rules in _RULES.items():
        checks = {check: condition() for check, (_, condition) in rules.items()}
        counted = source(relation).agg(
            *(F.count(F.when(condition, 1)).alias(name) for name, condition in checks.items())
        )
        reports.append(
            counted.unpivot([], list(checks), "check_name", "affected_rows").select(
                F.lit(relation).alias("table_name"), "check_name", "affected_rows"
            )
        )
    return stacked(reports)


def blank_products_by_column(products: DataFrame) -> DataFrame:
    return products.agg(
        F.count("*").alias("total_products"),
        *(
            count_where(blank(name)).alias(f"missing_{name}")
            for name in ("category", "brand", "department", "name")
        ),
    )


def worst_ship_gaps(items: DataFrame, rows: int = 20) -> DataFrame:
    """The items shipped longest before they were created."""
    return (
        items.where(F.col("shipped_at") < F.col("created_at"))
        .select(
            "id",
            "order_id",
            "created_at",
            "shipped_at",
            hours_between(F.col("created_at"), F.col("shipped_at")).alias("hours_to_ship"),
        )
        .orderBy("hours_to_ship", "id")
        .limit(rows)
    )


def session_profile(events: DataFrame) -> DataFrame:
    """One row per session, NULL included: its steps and attributes; stored, as all session checks read it.

    Steps are grouped first, so a hot session is spread over its steps before it is one row.
    """
    step, rows = F.col("sequence_number"), F.col("_rows")
    attributes = ("traffic_source", "browser")
    steps = (
        events.withColumn("session_id", unpadded(F.col("session_id")))
        .groupBy("session_id", "sequence_number")
        .agg(
            F.count("*").alias("_rows"),
            *(f(unpadded(F.col(c))).alias(f"{name}_{c}") for c in attributes for name, f in _ENDS),
        )
    )
    return steps.groupBy("session_id").agg(
        F.count(F.when(rows > 1, 1)).alias("repeated_steps"),
        F.min(step).alias("first_step"),
        F.max(step).alias("last_step"),
        F.coalesce(F.sum(F.when(step.isNotNull(), rows)), F.lit(0)).alias("numbered_events"),
        *(f(f"{name}_{c}").alias(f"{name}_{c}") for c in attributes for name, f in _ENDS),
    )


_ENDS = (("least", F.min), ("greatest", F.max))


def duplicate_session_sequences(sessions: DataFrame) -> DataFrame:
    return sessions.agg(F.coalesce(F.sum("repeated_steps"), F.lit(0)).alias("duplicate_session_sequences"))


def session_gaps(sessions: DataFrame) -> DataFrame:
    """Sessions whose steps do not run 1, 2, ... up to their number."""
    known = sessions.where("session_id IS NOT NULL AND numbered_events > 0")
    gaps = known.where("first_step <> 1 OR last_step <> numbered_events")
    return gaps.agg(F.count("*").alias("sessions_with_sequence_gaps"))


def inconsistent_sessions(sessions: DataFrame) -> DataFrame:
    """Sessions seen with several sources or browsers; NULL is not a second one."""
    several = "least_traffic_source <> greatest_traffic_source OR least_browser <> greatest_browser"
    found = sessions.where("session_id IS NOT NULL").where(several)
    return found.agg(F.count("*").alias("sessions_with_multiple_attributes"))
