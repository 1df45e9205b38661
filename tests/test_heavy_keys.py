"""Joins in which one key holds a third of the rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from small import relation

from haberdash.operators import skew
from haberdash.operators.skew import PIECE, heavy_keys, salted_join
from haberdash.plans import model


@pytest.fixture(scope="module")
def rows(spark):
    n = F.col("id")
    return spark.range(300_000).select(
        "id", F.when(n % 3 == 0, 7).when(n % 50 == 1, 8).otherwise(n % 90_000).alias("key")
    ).cache()


def test_heavy_keys_are_found(rows):
    values, pieces = heavy_keys(rows, "key")["key"]
    assert values == [7, 8] and pieces >= 100


def test_no_piece_holds_more_than_its_share(spark, rows):
    heavy = heavy_keys(rows, "key")["key"]
    parents = spark.range(90_000).select(F.col("id").alias("key"), (F.col("id") * 2).alias("value"))
    joined = salted_join(rows, parents, "key", heavy, "id")
    assert joined.columns == ["key", "id", "value"]
    assert joined.count() == 300_000 and joined.where("value <> 2 * key").isEmpty()
    # The join's own pieces: default thresholds, every third row in one key.
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert PIECE in plan
    piece = F.when(F.col("key").isin(heavy[0]), F.pmod(F.xxhash64("id"), F.lit(heavy[1]))).otherwise(0)
    most = rows.groupBy("key", piece.alias("p")).count().agg(F.max("count")).first()[0]
    assert most < 1.25 * skew.LEAST_ROWS


def test_a_join_without_heavy_keys_stays_plain(spark):
    few = spark.range(500).select("id", F.lit(1).alias("key"))
    heavy = heavy_keys(few, "key")["key"]
    assert heavy[0] == []
    plan = salted_join(few, few.select("key").distinct(), "key", heavy, "id")
    assert PIECE not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_empty_and_missing_keys(spark):
    assert heavy_keys(spark.range(0).withColumn("key", F.lit(None).cast("bigint")), "key")["key"][0] == []
    rows = spark.range(9000).select("id", F.when(F.col("id") < 4000, 5).alias("key"))
    assert heavy_keys(rows, "key")["key"][0] == [5]


def test_items_of_one_order(spark, monkeypatch):
    """A third of all items in one order, and missing references, against the plain join."""
    n = F.col("id")
    frames = {
        "order_items": spark.range(9000).select(
            "id", F.when(n % 3 == 0, 1).otherwise(n).alias("order_id"), n.alias("inventory_item_id"),
            F.lit("Complete").alias("status"), F.lit(5.0).alias("sale_price"),
        ),
        "orders": spark.range(8000).select(n.alias("order_id"), F.lit("Complete").alias("status")),
        "inventory_items": spark.range(8500).select("id", n.alias("product_id")),
    }
    from haberdash.plans import cleaned

    empty = {name: relation(spark, name) for name in frames}
    views = {
        name: cleaned.VIEWS[name](empty[name].unionByName(frame, allowMissingColumns=True).select(empty[name].columns))
        for name, frame in frames.items()
    }
    needs, build = model.TABLES["fact_order_items"]
    salted = build(*(views[name] for name in needs))
    assert PIECE in salted._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(skew, "LEAST_ROWS", 10**9)
    plain = build(*(views[name] for name in needs))
    assert salted.count() == plain.count() and salted.exceptAll(plain).isEmpty()
