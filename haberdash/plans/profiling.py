"""Profiling of the raw relations: counts, gaps, coverage and ranges."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haberdash.functions.columns import PRICE, flag, unpadded
from haberdash.operators.keys import stacked


def _labelled(report: DataFrame, name: str) -> DataFrame:
    return report.select(F.lit(name).alias("table_name"), "*")


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    return stacked(
        _labelled(frame.agg(F.count("*").alias("row_count")), name) for name, frame in tables.items()
    )


def column_report(tables: Mapping[str, DataFrame], keys: Mapping[str, str]) -> DataFrame:
    """Columns of each relation in order: type, whether it is the key, and NULLs in one pass."""
    reports = []
    for name, frame in tables.items():
        fields = frame.schema.fields
        gaps = frame.agg(*((F.count("*") - F.count(f.name)).alias(f.name) for f in fields))
        described = F.array(
            *(
                F.struct(
                    F.lit(place).alias("position"),
                    F.lit(f.name).alias("column_name"),
                    F.lit(f.dataType.simpleString()).alias("data_type"),
                    F.lit(f.name == keys[name]).alias("is_key"),
                    F.col(f.name).alias("null_rows"),
                )
                for place, f in enumerate(fields, start=1)
            )
        )
        reports.append(_labelled(gaps.select(F.inline(described)), name))
    return stacked(reports)


def content_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Per relation: rows, NULL cells and characters of text, in one pass each."""
    reports = []
    for name, frame in tables.items():
        fields = frame.schema.fields
        text = [f.name for f in fields if f.dataType.simpleString() == "string"]
        gaps = sum((flag(F.col(f.name).isNull()) for f in fields), F.lit(0).cast("bigint"))
        letters = sum(
            (F.coalesce(F.length(t), F.lit(0)) for t in text), F.lit(0).cast("bigint")
        )
        reports.append(
            _labelled(
                frame.agg(
                    F.count("*").alias("row_count"),
                    F.sum(gaps).alias("null_cells"),
                    F.sum(letters).alias("text_length"),
                ),
                name,
            )
        )
    return stacked(reports)


def preview(frame: DataFrame, key: str, rows: int = 20) -> DataFrame:
    """The first rows by key: a look at the data, so the limit is the point."""
    return frame.orderBy(key).limit(rows)


def missing(frame: DataFrame, **columns: str) -> DataFrame:
    """Rows, and rows without a value, as ``missing_<label>`` per column."""
    return frame.agg(
        F.count("*").alias("total_rows"),
        *(
            (F.count("*") - F.count(column)).alias(f"missing_{label}")
            for label, column in columns.items()
        ),
    )


def date_coverage(tables: Mapping[str, DataFrame]) -> DataFrame:
    return stacked(
        _labelled(
            frame.agg(
                F.min("created_at").alias("earliest_date"), F.max("created_at").alias("latest_date")
            ),
            name,
        )
        for name, frame in tables.items()
    )


def frequencies(frame: DataFrame, column: str, count: str) -> DataFrame:
    """Rows per value, most frequent first; padded spellings count as one."""
    return (
        frame.groupBy(unpadded(F.col(column)).alias(column))
        .agg(F.count("*").alias(count))
        .orderBy(F.desc(count), F.col(column))
    )


def value_range(frame: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Least, greatest and average of each column, as ``<bound>_<label>``."""
    measures = []
    for label, value in columns.items():
        measures += [
            F.min(value).alias(f"minimum_{label}"),
            F.max(value).alias(f"maximum_{label}"),
            F.avg(value.cast(PRICE)).cast(PRICE).alias(f"average_{label}"),
        ]
    return frame.agg(*measures)
