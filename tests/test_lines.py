"""Order lines numbered inside their order, and what building a report writes and moves."""

from __future__ import annotations

import datetime as dt
import threading

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from haberdash.operators import skew
from haberdash.operators.keys import key_counts
from haberdash.operators.numbering import SLICE, totals_before
from haberdash.plans import model, reporting, sales
from haberdash.registry import QUERIES
from haberdash.sources import files
from haberdash.sources.testbed import LINE_ORDER, warehouse_over
from haberdash.sources.warehouse import Store

DAY = dt.datetime(2000, 1, 1)
COLUMNS = {
    "nation": "n_nationkey INT, n_name STRING",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}


def line(order, number, part=1):
    return (order, part, 1, number, 2.0, 10.0 + number, 0.1, 0.2, "N", "F", DAY)


ROWS = {
    "nation": [(1, "X")],
    "customer": [(n, f"c{n}", 1, 1.0, "S") for n in range(5)],
    "supplier": [(n, f"s{n}", 1, 1.0) for n in range(10)],
    "part": [(n, f"p{n}", "B", "T", 5, 10.0) for n in range(4)],
    "orders": [(n, n % 5, "F", 1.0, DAY, "1-URGENT") for n in range(12)],
    # Order 5 and lines without an order are many; two orders are not known; some lines are alike.
    "lineitem": [line(o, k % 4, k % 3) for o in range(14) for k in range(3)]
    + [line(5, k % 7, k % 2) for k in range(40)]
    + [line(None, k % 5) for k in range(30)],
    "events": [(n, DAY, n % 3, "view", 1.0, "{}") for n in range(6)],
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    place = tmp_path_factory.mktemp("lines")
    for table, rows in ROWS.items():
        spark.createDataFrame(rows, COLUMNS[table]).repartition(2).write.parquet(f"{place}/{table}.parquet")
    return str(place)


@pytest.fixture(params=[3, 1000], ids=["large orders", "no large orders"])
def opened(request, spark, folder, tmp_path, monkeypatch):
    monkeypatch.setattr(skew, "LEAST_ROWS", request.param)
    return warehouse_over(Store(spark, str(tmp_path)), folder)


def test_lines_are_numbered_in_the_order_of_all(spark, folder, opened):
    placed = spark.read.parquet(f"{folder}/lineitem.parquet").select(
        "*", F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")
    )
    through = Window.orderBy("l_orderkey", *LINE_ORDER, "_file", "_row")
    expected = placed.select(
        F.row_number().over(through).cast("bigint").alias("id"), "l_orderkey", "l_partkey", "l_extendedprice"
    )
    found = opened.source("order_items").select("id", "order_id", "product_id", "sale_price")
    price = F.col("l_extendedprice").cast("decimal(12,2)").cast("double")
    assert found.exceptAll(expected.withColumn("l_extendedprice", price)).isEmpty()
    assert found.count() == len(ROWS["lineitem"])


def test_lines_move_once(spark, folder, tmp_path):
    opened = warehouse_over(Store(spark, str(tmp_path)), folder)
    opened.source("order_items")
    assert opened.store.versions("import/line_slices") == []
    sizes = spark.read.parquet(opened.store.versions("import/order_sizes")[-1])
    assert "l_extendedprice" not in sizes.columns and sizes.count() == 15


@pytest.mark.parametrize("slices", [1, 4, 30])
def test_totals_before_equal_a_plain_window(spark, slices, tmp_path):
    rows = spark.range(50).select("id", (F.col("id") * 7 % 5).alias("n"))
    cut = rows.repartitionByRange(slices, "id").withColumn(SLICE, F.spark_partition_id())
    stored = Store(spark, str(tmp_path)).table("cut", lambda: cut)
    above = Window.orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    expected = rows.withColumn("before", F.coalesce(F.sum("n").over(above), F.lit(0)))
    found = totals_before(stored, ["id"], "n", "before").select("id", "n", "before")
    assert sorted(found.collect()) == sorted(expected.collect())


def test_a_working_table_does_not_write_the_fact(opened):
    before = sorted(map(str, opened.customer_orders().drop(SLICE).collect()))
    assert before and opened.store.versions("analytics/fact_order_items") == []
    assert not opened.store.has("analytics/fact_order_items", opened._state(["order_items"]))
    opened.model("fact_order_items")
    opened.store.drop("work/")
    assert sorted(map(str, opened.customer_orders().drop(SLICE).collect())) == before
    plan = opened.model_plan("fact_order_items")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_counts_and_shares_do_not_write_the_model(opened):
    counts = {r[0]: r[1] for r in QUERIES["row_counts_model"](opened).collect()}
    assert counts["fact_order_items"] == 36 + 40 and counts["fact_events"] == 6
    shares = QUERIES["flagged_revenue_share"](opened).collect()
    assert opened.store.stored("analytics") == []
    opened.build("analytics")
    assert {r[0]: r[1] for r in QUERIES["row_counts_model"](opened).collect()} == counts
    assert QUERIES["flagged_revenue_share"](opened).collect() == shares


def test_key_counts_move_no_names(spark):
    tables = {"orders": (spark.createDataFrame([(1,), (1,), (None,)], "id BIGINT"), "id")}
    tables["users"] = (spark.createDataFrame([("1",), ("2",), (None,)], "name STRING"), "name")
    found = key_counts(tables)
    assert sorted(map(str, found.collect())) == sorted(
        f"Row(table_name='{t}', key={k!r}, rows={n})"
        for t, k, n in [("orders", "1", 2), ("orders", None, 1), ("users", "1", 1), ("users", "2", 1), ("users", None, 1)]
    )
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_table" in plan and "hashpartitioning(table_name" not in plan


def test_relations_are_exported_at_the_same_time(opened, monkeypatch):
    together = threading.Barrier(3, timeout=60)
    write = files.write_csv

    def meeting(frame, path):
        # Seven relations: the first three meet here, the rest go on.
        if path.rpartition("/")[2] in ("users.csv", "products.csv", "orders.csv"):
            together.wait()
        write(frame, path)

    monkeypatch.setattr(files, "write_csv", meeting)
    counts = {r["table_name"]: r["row_count"] for r in QUERIES["load_csv"](opened).collect()}
    assert counts["order_items"] == len(ROWS["lineitem"]) and len(counts) == 7


def test_store_has_what_is_complete_and_not_dropped(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert not store.has("work/n", "a")
    store.table("work/n", lambda: spark.range(3), "a")
    assert store.has("work/n", "a") and not store.has("work/n", "b")
    assert Store(spark, str(tmp_path)).has("work/n", "a")
    store.drop("work/")
    assert not store.has("work/n", "a")
    assert all(".zstd." in p.name for p in tmp_path.glob("work/n/*/*.parquet"))


def test_stock_without_texts_is_the_same_stock(spark, folder, tmp_path):
    for table, rows in ROWS.items():
        # Products 1 and 3 are there more than once, one has no key.
        more = [(1, "again", "B", "T", 5, 11.0), (3, "p3", "B", "T", 5, 10.0), (3, "p3", "B", "T", 5, 10.0),
                (None, "none", "B", "T", 5, 10.0), (None, "none", "B", "T", 5, 9.0)]
        rows = rows + (more if table == "part" else [line(6, 3, None)] if table == "lineitem" else [])
        spark.createDataFrame(rows, COLUMNS[table]).write.parquet(f"{tmp_path}/in/{table}.parquet")
    opened = warehouse_over(Store(spark, f"{tmp_path}/out"), f"{tmp_path}/in")
    names = model.READ["inventory_items"]
    queries = ("date_coverage", "sold_before_created", "inventory_aging", "slow_movers")

    def results():
        return [sorted(map(str, QUERIES[q](opened).collect())) for q in queries]

    slim, before = opened.source_columns("inventory_items", *names), results()
    facts = sorted(map(str, opened.model_plan("fact_order_items").collect()))
    assert opened.store.versions("src/inventory_items") == []
    assert opened.store.versions("analytics/fact_inventory") == []
    whole = opened.source("inventory_items").select(*names)
    assert slim.dtypes == whole.dtypes
    assert slim.exceptAll(whole).isEmpty() and whole.exceptAll(slim).isEmpty()
    assert facts == sorted(map(str, opened.model_plan("fact_order_items").collect()))
    assert results() == before
    # Once stored, the relation is read where it lies.
    assert "src/inventory_items" in opened.source_columns("inventory_items", "id").inputFiles()[0]


def test_stock_with_texts_has_them(opened):
    text = opened.source_columns("inventory_items", "id", "product_name")
    whole = opened._load("inventory_items").select("id", "product_name")
    assert sorted(map(str, text.collect())) == sorted(map(str, whole.collect()))
    assert text.where("product_name IS NOT NULL").count() > 0


def test_reports_share_narrow_items(opened):
    rows = {name: sorted(map(str, opened.report(name).collect())) for name in reporting.VIEWS}
    assert opened.store.versions("analytics/fact_order_items") == []
    assert opened.store.versions("analytics/fact_inventory") == []
    stored = opened.working("center_orders").columns, opened.input("fact_order_items")
    assert set(stored[1].columns) == set(sales.REPORTED)
    opened.build_model()
    opened.store.drop("work/")
    assert "item_cost" in opened.input("fact_order_items").columns
    assert {name: sorted(map(str, opened.report(name).collect())) for name in reporting.VIEWS} == rows
    assert opened.working("center_orders").columns == stored[0]
