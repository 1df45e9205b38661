"""Literal relations for tests: name the columns that matter, the rest are NULL."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from haberdash.plans import cleaned, model
from haberdash.sources.schemas import SOURCE_SCHEMAS

CUTOFF = dt.date(2024, 1, 1)
TESTDATA = Path("/root/testdata")


def relation(spark: SparkSession, name: str, *rows: dict) -> DataFrame:
    schema = StructType.fromDDL(SOURCE_SCHEMAS[name])
    values = [tuple(row.get(field, None) for field in schema.names) for row in rows]
    return spark.createDataFrame(values, schema)


def at(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def sold(spark: SparkSession, *rows: dict) -> DataFrame:
    """An order-item fact from rows of order, customer, product, status, date, revenue, profit."""
    values = [
        (
            r.get("order", 1),
            r.get("customer", 1),
            r.get("product", 1),
            r.get("center", 1),
            r.get("status", "Complete"),
            dt.date.fromisoformat(r.get("date", "2023-05-01")),
            Decimal(r.get("revenue", "10.00")),
            Decimal(r.get("profit", "4.00")),
            r.get("ship"),
            r.get("deliver"),
        )
        for r in rows
    ]
    frame = spark.createDataFrame(
        values,
        "order_id BIGINT, customer_id BIGINT, product_id BIGINT, distribution_center_id BIGINT, "
        "item_status STRING, order_date DATE, item_revenue DECIMAL(12,2), "
        "gross_profit_before_returns DECIMAL(12,2), days_to_ship INT, days_to_deliver INT",
    )
    return frame.withColumns(
        {
            "returned_flag": F.when(F.col("item_status") == "Returned", 1).otherwise(0),
            "cancelled_flag": F.when(F.col("item_status") == "Cancelled", 1).otherwise(0),
        }
    )


def clean(name: str, frame: DataFrame) -> DataFrame:
    return cleaned.VIEWS[name](frame)


def built(name: str, *frames: DataFrame) -> DataFrame:
    return model.TABLES[name][1](*frames)


def only(frame: DataFrame) -> dict:
    rows = frame.collect()
    assert len(rows) == 1, rows
    return rows[0].asDict()


def values(frame: DataFrame, *names: str) -> list[tuple]:
    return [tuple(r) for r in frame.select(*names).collect()]
