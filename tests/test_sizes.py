"""Stored tables whose files are small and whose rows are not."""

from __future__ import annotations

import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from haberdash.operators.sizes import sized
from haberdash.plans import customers, products
from haberdash.sources import files
from haberdash.sources.warehouse import Store, shuffles_removed

ROWS = 400_000


def physical(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Products, customers, items and orders, each some hundred kilobytes of files and over ten megabytes of rows."""
    store = Store(spark, str(tmp_path_factory.mktemp("sizes")))
    keys = spark.range(ROWS)
    amounts = [F.lit(1).cast("decimal(38,2)").alias(n) for n in ("net_revenue", "gross_profit")]
    item = F.col("id").alias("product_id")
    tables = {
        "products": keys.select(item, F.concat(F.lit("b"), F.col("id") % 3).alias("brand")),
        "items": keys.select(item, F.lit(1).alias("valid_items"), F.lit(0).alias("returned_items"), *amounts),
        "customers": keys.select(
            F.col("id").alias("customer_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("acquisition_source")
        ),
        "orders": keys.select(
            F.col("id").alias("customer_id"), F.col("id").alias("order_id"), F.lit(1).alias("valid_items"), *amounts
        ),
    }
    return {name: store.table(name, lambda t=table: t) for name, table in tables.items()}


def test_reports_do_not_broadcast_packed_tables(spark, stored):
    limit = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    for name in ("products", "customers"):
        assert int(str(stored[name]._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < limit
    brands = products.brand_performance(stored["items"], stored["products"])
    sources = customers.by_acquisition_source(stored["orders"], stored["customers"])
    for report in (brands, sources):
        assert "BroadcastExchange" not in physical(report)
    assert sum(r["total_items"] for r in brands.collect()) == ROWS
    assert sum(r["total_customers"] for r in sources.collect()) == ROWS


def test_small_tables_are_left_to_spark(stored):
    few = stored["products"].limit(10)
    assert sized(few) is few
    assert "BroadcastHashJoin" in physical(stored["items"].join(sized(few), "product_id"))


def test_shuffle_files_go_when_a_table_is_stored(spark, tmp_path, monkeypatch):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, seen = spark.conf.get(name, None), []
    build = type(spark.range(1).write).parquet

    def parquet(self, *args, **more):
        seen.append(spark.conf.get(name, None))
        return build(self, *args, **more)

    monkeypatch.setattr(type(spark.range(1).write), "parquet", parquet)
    Store(spark, str(tmp_path)).table("t", lambda: spark.range(100).repartition(3))
    assert seen == ["true"] and spark.conf.get(name, None) == before
    # Of two writers the one that leaves first leaves the setting to the other.
    first, second = threading.Event(), threading.Event()

    def early():
        with shuffles_removed(spark):
            first.set()
            second.wait(30)

    thread = threading.Thread(target=early)
    thread.start()
    first.wait(30)
    with shuffles_removed(spark):
        second.set()
        thread.join()
        assert spark.conf.get(name, None) == "true"
    assert spark.conf.get(name, None) == before


def test_exported_files_are_packed(spark, tmp_path):
    day = dt.datetime(2020, 1, 1, 1, 2, 3)
    text = 'a "quoted", text '
    rows = spark.range(20_000).select(
        *(F.lit(None).cast(kind).alias(n) if n not in ("id", "uri", "created_at") else
          {"id": F.col("id"), "uri": F.lit(text), "created_at": F.lit(day).cast(kind)}[n].alias(n)
          for n, kind in (f.strip().split(" ") for f in files.SOURCE_SCHEMAS["events"].split(",")))
    )
    files.write_csv(rows, f"{tmp_path}/events.csv")
    size = sum(p.stat().st_size for p in (tmp_path / "events.csv").iterdir() if not p.name.startswith("."))
    assert size < 20_000 * len(text) / 2
    back = files.read_csv(spark, "events", f"{tmp_path}/events.csv")
    assert back.schema == rows.schema or back.dtypes == rows.dtypes
    assert back.count() == 20_000 and back.exceptAll(rows).count() == 0
