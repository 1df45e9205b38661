"""Web-session funnel: product view, cart, purchase."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haberdash.functions.columns import flag, percent

SESSION = ("session_id", "traffic_source", "browser")

# Flag and the event type that sets it.
STEPS = {"product_view_flag": "product", "cart_flag": "cart", "purchase_flag": "purchase"}


def _events_before(events: DataFrame, cutoff: dt.date) -> DataFrame:
    return events.where(F.col("event_date") < F.lit(cutoff))


def event_types(events: DataFrame, cutoff: dt.date) -> DataFrame:
    return (
        _events_before(events, cutoff)
        .groupBy("event_type")
        .agg(F.count("*").alias("total_events"))
        .orderBy(F.desc("total_events"), "event_type")
    )


def sessions(events: DataFrame, cutoff: dt.date) -> DataFrame:
    """One row per session, source and browser; a session may have several of these.

    Stored, as all reports on the funnel read it.
    """
    return (
        _events_before(events, cutoff)
        .where(F.col("session_id").isNotNull())
        .groupBy(*SESSION)
        .agg(
            F.min("event_date").alias("session_date"),
            F.count("*").alias("total_events"),
            *(
                F.max(flag(F.col("event_type") == event)).alias(name)
                for name, event in STEPS.items()
            ),
        )
    )


def session_flags(stored: DataFrame) -> DataFrame:
    """Which steps each session reached."""
    return stored.drop("total_events")


def session_funnel(stored: DataFrame) -> DataFrame:
    """Sessions with their size, period and the step they were lost at."""
    viewed, carted, bought = (F.col(name) == 1 for name in STEPS)
    return stored.select(
        *SESSION,
        "session_date",
        F.year("session_date").alias("session_year"),
        F.month("session_date").alias("session_month"),
        "total_events",
        *STEPS,
        flag(viewed & ~carted).alias("product_to_cart_dropoff_flag"),
        flag(carted & ~bought).alias("cart_to_purchase_dropoff_flag"),
    )


def cart_without_product(sessions: DataFrame) -> DataFrame:
    skipped = sessions.where("cart_flag = 1 AND product_view_flag = 0")
    return skipped.agg(F.count("*").alias("cart_without_product"))


def purchase_without_cart(sessions: DataFrame) -> DataFrame:
    skipped = sessions.where("purchase_flag = 1 AND cart_flag = 0")
    return skipped.agg(F.count("*").alias("purchase_without_cart"))


def _reach(sessions: DataFrame, *by: str | Column) -> DataFrame:
    """Sessions per group and how many reached each step."""
    return sessions.groupBy(*by).agg(
        F.count("*").alias("total_sessions"),
        F.sum("product_view_flag").alias("product_view_sessions"),
        F.sum("cart_flag").alias("cart_sessions"),
        F.sum("purchase_flag").alias("purchase_sessions"),
    )


def _conversion() -> Column:
    return percent(F.col("purchase_sessions"), F.col("total_sessions"))


def _step_rates() -> dict[str, Column]:
    return {
        "product_to_cart_rate": percent(F.col("cart_sessions"), F.col("product_view_sessions")),
        "cart_to_purchase_rate": percent(F.col("purchase_sessions"), F.col("cart_sessions")),
        "session_conversion_rate": _conversion(),
    }


def funnel_overall(sessions: DataFrame) -> DataFrame:
    return (
        _reach(sessions)
        .withColumns(
            {
                "product_to_cart_dropoff": F.col("product_view_sessions") - F.col("cart_sessions"),
                "cart_to_purchase_dropoff": F.col("cart_sessions") - F.col("purchase_sessions"),
            }
        )
        .withColumns(_step_rates())
    )


def _funnel_by(sessions: DataFrame, name: str) -> DataFrame:
    return (
        _reach(sessions, name)
        .withColumns(_step_rates())
        .orderBy(F.desc("session_conversion_rate"), name)
    )


def funnel_by_source(sessions: DataFrame) -> DataFrame:
    return _funnel_by(sessions, "traffic_source")


def funnel_by_browser(sessions: DataFrame) -> DataFrame:
    return _funnel_by(sessions, "browser")


def funnel_monthly(sessions: DataFrame) -> DataFrame:
    return (
        _reach(
            sessions,
            F.year("session_date").alias("session_year"),
            F.month("session_date").alias("session_month"),
        )
        .withColumn("session_conversion_rate", _conversion())
        .orderBy("session_year", "session_month")
    )
