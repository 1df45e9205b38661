"""Cleaned layer: trimmed text, blanks as NULL, one spelling per country."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haberdash.functions.columns import blank_to_null, flag, unpadded

# Spellings found in the source and the name each stands for.
COUNTRY_NAMES = {"Deutschland": "Germany", "España": "Spain", "Brasil": "Brazil"}


def _clean(frame: DataFrame, *text: str) -> DataFrame:
    return frame.withColumns({name: blank_to_null(F.col(name)) for name in text})


def standard_country(country: Column) -> Column:
    """The agreed name of a trimmed country; other names pass through."""
    result = country
    for spelling, name in COUNTRY_NAMES.items():
        result = F.when(country == spelling, name).otherwise(result)
    return result


def impossible_dates() -> Column:
    """Condition: some step is dated before the step it follows."""
    return (
        (F.col("shipped_at") < F.col("created_at"))
        | (F.col("delivered_at") < F.col("shipped_at"))
        | (F.col("returned_at") < F.col("delivered_at"))
    )


def users(raw: DataFrame) -> DataFrame:
    frame = _clean(
        raw,
        "first_name",
        "last_name",
        "email",
        "gender",
        "state",
        "street_address",
        "postal_code",
        "city",
        "country",
        "traffic_source",
    )
    return frame.withColumn("country", standard_country(F.col("country")))


def products(raw: DataFrame) -> DataFrame:
    return _clean(raw, "category", "name", "brand", "department", "sku")


def orders(raw: DataFrame) -> DataFrame:
    return _clean(raw, "status", "gender")


def order_items(raw: DataFrame) -> DataFrame:
    """Impossible dates are marked, never removed: the rows carry real revenue."""
    return _clean(raw, "status").withColumn("invalid_date_sequence_flag", flag(impossible_dates()))


def inventory_items(raw: DataFrame) -> DataFrame:
    texts = ("product_category", "product_name", "product_brand", "product_department", "product_sku")
    return _clean(raw, *(name for name in texts if name in raw.columns))


def distribution_centers(raw: DataFrame) -> DataFrame:
    return _clean(raw, "name")


def events(raw: DataFrame) -> DataFrame:
    return _clean(
        raw,
        "session_id",
        "ip_address",
        "city",
        "state",
        "postal_code",
        "browser",
        "traffic_source",
        "uri",
        "event_type",
    )


VIEWS = {
    "users": users,
    "products": products,
    "orders": orders,
    "order_items": order_items,
    "inventory_items": inventory_items,
    "distribution_centers": distribution_centers,
    "events": events,
}


def country_spellings(people: DataFrame) -> DataFrame:
    """Users per spelling, for the names that have more than one."""
    spellings = sorted({*COUNTRY_NAMES, *COUNTRY_NAMES.values()})
    return (
        people.select(unpadded(F.col("country")).alias("country"))
        .where(F.col("country").isin(spellings))
        .groupBy("country")
        .agg(F.count("*").alias("user_count"))
        .orderBy("country")
    )
