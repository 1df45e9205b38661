"""Layers, stored tables, and files in and out."""

from __future__ import annotations

import datetime as dt

import pytest
from small import CUTOFF, TESTDATA, at, relation, values

from haberdash import Warehouse
from haberdash.sources import files
from haberdash.sources.schemas import MODEL_KEYS, SOURCE_SCHEMAS
from haberdash.sources.testbed import open_testbed
from haberdash.sources.warehouse import LAYERS, Store, shared_folder

ROWS = {
    "users": [{"id": 1, "first_name": "  ", "country": " España", "created_at": at("2022-01-01 10:11:12.123456")}],
    "products": [{"id": 1, "name": 'a "quoted", name', "brand": None, "cost": 2.5, "retail_price": 5.0}],
    "orders": [{"order_id": 1, "user_id": 1, "status": "Complete", "created_at": at("2023-01-01"), "num_of_item": 1}],
    "order_items": [{"id": 1, "order_id": 1, "user_id": 1, "product_id": 1, "inventory_item_id": 1, "sale_price": 5.0}],
    "inventory_items": [{"id": 1, "product_id": 1, "created_at": at("2022-12-01"), "cost": 2.5}],
    "distribution_centers": [{"id": 1, "name": "East", "latitude": 1.5, "longitude": -2.0}],
    "events": [{"id": 1, "session_id": "s", "created_at": at("2023-01-01"), "uri": '{"k": 1}'}],
}


@pytest.fixture
def folder(spark, tmp_path):
    for name, rows in ROWS.items():
        files.write_csv(relation(spark, name, *rows), f"{tmp_path}/in/{name}.csv")
    return f"{tmp_path}/in"


@pytest.fixture
def imported(spark, folder, tmp_path):
    return Warehouse.from_csv(spark, folder, CUTOFF, CUTOFF, root=f"{tmp_path}/out")


def test_csv_import_keeps_every_value(spark, imported):
    for name, rows in ROWS.items():
        frame = imported.source(name)
        assert frame.collect() == relation(spark, name, *rows).collect(), name


def test_csv_row_of_the_wrong_type_fails(spark, tmp_path):
    (tmp_path / "centers.csv").write_text("id,name,latitude,longitude\n1,East,north,2.0\n")
    with pytest.raises(Exception, match="MALFORMED_RECORD|Malformed"):
        files.read_csv(spark, "distribution_centers", f"{tmp_path}/centers.csv").collect()


BAD_CENTERS = (
    "name,id,extra,latitude,longitude\n"
    "East,1,x,1.5,2.0\n"
    'We"st,2,x,north,south\n'
    '"a, ""b""",three,,1.0,\n'
    "short,4\n"
    "long,5,x,1.0,2.0,6\n"
    ",,,,\n"
)


def test_csv_rows_that_do_not_fit_are_set_aside(spark, tmp_path):
    (tmp_path / "centers.csv").write_text(BAD_CENTERS)
    path = f"{tmp_path}/centers.csv"
    kept = files.read_csv(spark, "distribution_centers", path, set_aside=True)
    assert [r[:] for r in kept.collect()] == [(1, "East", 1.5, 2.0), (None, None, None, None)]
    assert kept.count() == 2 and kept.select("name").count() == 2 and kept.where("latitude = 1.0").count() == 0
    rejected = files.rejected_rows(spark, "distribution_centers", path)
    assert rejected.columns == ["relation", "file", "line", "columns"]
    lines = BAD_CENTERS.splitlines()
    found = {r["line"]: r["columns"] for r in rejected.collect()}
    assert found == {lines[2]: ["latitude", "longitude"], lines[3]: ["id"], lines[4]: [], lines[5]: []}
    assert rejected.count() == 4 and all(r["file"].endswith("/centers.csv") for r in rejected.collect())


def test_warehouse_keeps_rejected_rows_apart(spark, folder, tmp_path):
    (tmp_path / "in" / "distribution_centers.csv" / "part-bad.csv").write_text(
        "id,name,latitude,longitude\nx1,North,1.0,1.0\n"
    )
    root = f"{tmp_path}/out"
    strict = Warehouse.from_csv(spark, folder, CUTOFF, CUTOFF, root=root)
    with pytest.raises(Exception, match="MALFORMED_RECORD|Malformed"):
        strict.source("distribution_centers")
    with pytest.raises(ValueError, match="sets no rows aside"):
        strict.rejected()
    lenient = Warehouse.from_csv(spark, folder, CUTOFF, CUTOFF, root=root, set_aside=True)
    assert lenient.source("distribution_centers").count() == 1
    assert [(r["relation"], r["line"], r["columns"]) for r in lenient.rejected().collect()] == [
        ("distribution_centers", "x1,North,1.0,1.0", ["id"])
    ]
    assert lenient.rejected("users").count() == 0
    # Files that change bring new rejected rows with them.
    (tmp_path / "in" / "distribution_centers.csv" / "part-worse.csv").write_text(
        "id,name,latitude,longitude\n7,South,1.0,far\n8,Mid,1.0,2.0\n"
    )
    lenient.update()
    assert lenient.source("distribution_centers").count() == 2
    assert lenient.rejected("distribution_centers").count() == 2


def test_csv_with_other_columns_fails(spark, tmp_path):
    (tmp_path / "centers.csv").write_text("id,label,latitude,longitude\n1,East,1.0,2.0\n")
    with pytest.raises(Exception, match="header does not conform"):
        files.read_csv(spark, "distribution_centers", f"{tmp_path}/centers.csv").collect()


def test_csv_columns_go_by_name(spark, tmp_path):
    rows = "name,longitude,extra,id,latitude\nEast,2.0,x,1,1.5\n"
    (tmp_path / "centers.csv").write_text(rows)
    frame = files.read_csv(spark, "distribution_centers", f"{tmp_path}/centers.csv")
    assert frame.columns == ["id", "name", "latitude", "longitude"]
    assert frame.first()[:] == (1, "East", 1.5, 2.0)


def test_exported_times_are_understood(spark, tmp_path):
    forms = (
        "2023-01-02 03:04:05",
        "2023-01-02T03:04:05",
        "2023-01-02 03:04:05 UTC",
        "2023-01-02 03:04:05+00:00",
        "2023-01-02 03:04:05.000000 UTC",
        "",
    )
    lines = ["id,product_id,created_at,sold_at,cost,product_category,product_name,product_brand,"
             "product_retail_price,product_department,product_sku,product_distribution_center_id"]
    lines += [f"{n},1,{form},,1.0,a,b,c,2.0,d,e,3" for n, form in enumerate(forms)]
    (tmp_path / "stock.csv").write_text("\n".join(lines) + "\n")
    stock = files.read_csv(spark, "inventory_items", f"{tmp_path}/stock.csv")
    assert values(stock, "created_at") == [(at("2023-01-02 03:04:05"),)] * 5 + [(None,)]


def test_parquet_import(spark, tmp_path):
    relation(spark, "events", *ROWS["events"]).write.parquet(f"{tmp_path}/events")
    assert files.read_parquet(spark, "events", f"{tmp_path}/events").count() == 1


def test_layers_from_csv(imported):
    assert imported.cleaned("users").first().country == "Spain"
    assert imported.model("fact_order_items").count() == 1
    assert imported.report("customer_performance").count() == 0  # the item has no status
    assert imported.store.stored("analytics") == ["dim_customer", "fact_order_items"]


def test_parquet_sources_are_read_in_place(spark, tmp_path):
    for name, rows in ROWS.items():
        relation(spark, name, *rows).write.parquet(f"{tmp_path}/{name}.parquet")
    held = Warehouse.from_parquet(spark, str(tmp_path), CUTOFF, CUTOFF, root=f"{tmp_path}/out")
    assert held.source("users").collect() == relation(spark, "users", *ROWS["users"]).collect()
    held.build_model()
    assert held.store.stored("src") == []
    assert held.model("fact_order_items").count() == 1


def test_stored_tables_are_built_once(spark, tmp_path):
    store, built = Store(spark, str(tmp_path)), []

    def build():
        built.append(1)
        return spark.range(3)

    assert store.table("a/x", build).count() == store.table("a/x", build).count() == 3
    assert len(built) == 1
    held = store.table("a/x", build)
    store.drop("a/")
    assert store.table("a/x", lambda: spark.range(5)).count() == 5
    assert held.count() == 3


def test_a_second_session_reuses_what_is_stored(spark, tmp_path):
    root, built = str(tmp_path), []

    def build():
        built.append(1)
        return spark.range(len(built))

    one, two = Store(spark, root), Store(spark.newSession(), root)
    held = one.table("a/x", build)
    assert two.table("a/x", build).inputFiles() == held.inputFiles() and len(built) == 1
    two.drop("a/")
    assert two.table("a/x", build).count() == 2
    assert held.count() == 1  # its reader is not disturbed
    for _ in range(3):
        two.drop("a/")
        two.table("a/x", build)
    assert len(list((tmp_path / "a/x").iterdir())) == 2
    (tmp_path / "a/x/v99999999-lost").mkdir()  # a writer that did not finish
    assert Store(spark, root).table("a/x", build).count() == 5 and len(built) == 5


def test_rebuild_writes_the_model_again(imported):
    imported.build_model()
    before = imported.model("dim_customer").inputFiles()
    imported.rebuild_model()
    assert imported.store.stored("analytics") == sorted(MODEL_KEYS)
    assert set(before).isdisjoint(imported.model("dim_customer").inputFiles())


def test_model_with_repeated_keys_is_refused(spark, folder, tmp_path):
    twice = relation(spark, "users", *ROWS["users"], *ROWS["users"])
    files.write_csv(twice, f"{folder}/users.csv")
    broken = Warehouse.from_csv(spark, folder, CUTOFF, CUTOFF, root=f"{tmp_path}/broken")
    with pytest.raises(ValueError, match="users: 0 NULL, 1 repeated"):
        broken.build_model()


def test_session_flags_are_kept_until_dropped(imported):
    files_before = imported.session_flags().inputFiles()
    assert imported.session_flags().inputFiles() == files_before
    imported.drop_session_flags()
    assert imported.session_flags().inputFiles() != files_before


def test_catalog(spark, imported):
    imported.create_layers()
    imported.create_layers()
    databases = {d.name for d in spark.catalog.listDatabases()}
    assert set(LAYERS) <= databases
    imported.register_views()
    assert spark.sql("SELECT country FROM cleaned_users").first().country == "Spain"
    assert spark.sql("SELECT count(*) AS n FROM reporting_sales_monthly").first().n == 0
    imported.register_tables()
    assert spark.sql("SELECT country FROM cleaned.users").first().country == "Spain"
    assert spark.sql("SELECT count(*) AS n FROM reporting.sales_monthly").first().n == 0
    for layer in LAYERS:
        tables = {t.name for t in spark.catalog.listTables(layer) if not t.isTemporary}
        assert tables == set(imported.names(layer))
        spark.sql(f"DROP DATABASE {layer} CASCADE")


def _catalog(spark, entry):
    return spark.sql(f"SELECT * FROM {entry}").count()


@pytest.fixture
def dropped(spark):
    yield
    for layer in LAYERS:
        spark.sql(f"DROP DATABASE IF EXISTS {layer} CASCADE")


def test_catalog_tables_outlive_rebuilds(spark, imported, dropped):
    imported.register_tables()
    first = imported.store._location("analytics.fact_orders")
    for _ in range(3):
        imported.rebuild_model()
        for layer in LAYERS:
            for name in imported.names(layer):
                _catalog(spark, f"{layer}.{name}")
    assert _catalog(spark, "analytics.fact_orders") == 1
    assert imported.store._location("analytics.fact_orders") != first
    assert first.rpartition("/")[2] not in [v.rpartition("/")[2] for v in imported.store.versions("analytics/fact_orders")]


def test_another_session_moves_the_catalog_on(spark, folder, tmp_path, imported, dropped):
    imported.register_tables(["analytics"])
    other = Warehouse.from_csv(spark.newSession(), folder, CUTOFF, CUTOFF, root=f"{tmp_path}/out")
    for _ in range(3):
        other.rebuild_model()
    spark.catalog.refreshTable("analytics.fact_orders")
    assert _catalog(spark, "analytics.fact_orders") == 1


def _versions(warehouse):
    return {
        f"{layer}/{name}": len(warehouse.store.versions(f"{layer}/{name}"))
        for layer in ("src", "analytics")
        for name in warehouse.names(layer)
    }


def test_update_writes_only_what_depends_on_changed_files(spark, folder, imported, dropped):
    imported.register_tables()
    imported.session_flags()
    assert set(_versions(imported).values()) == {1}
    assert imported.update() == []
    assert set(_versions(imported).values()) == {1}
    more = [{"id": n, "session_id": "s", "created_at": at("2023-01-01"), "event_type": "cart"} for n in (1, 2)]
    files.write_csv(relation(spark, "events", *more), f"{folder}/events.csv")
    assert imported.update() == ["events"]
    written = {name for name, n in _versions(imported).items() if n == 2}
    assert written == {"src/events", "analytics/fact_events"}
    assert imported.model("fact_events").count() == _catalog(spark, "analytics.fact_events") == 2
    assert _catalog(spark, "cleaned.events") == 2
    assert imported.session_flags().first().cart_flag == 1
    assert spark.sql("SELECT max(cart_flag) AS n FROM reporting.session_funnel").first().n == 1


def test_a_later_session_reuses_all_but_changed_relations(spark, folder, tmp_path, imported):
    imported.build_model()
    files.write_csv(relation(spark, "users", {"id": 5}), f"{folder}/users.csv")
    later = Warehouse.from_csv(spark, folder, CUTOFF, CUTOFF, root=f"{tmp_path}/out")
    later.build_model()
    assert {n for n, count in _versions(later).items() if count == 2} == {"src/users", "analytics/dim_customer"}
    assert later.model("dim_customer").first().customer_id == 5


def test_listings_come_from_the_catalog(spark, imported, dropped):
    listed = {layer: list(imported.listed(layer)) for layer in LAYERS}
    assert listed == {layer: imported.names(layer) for layer in LAYERS}
    spark.range(4).write.saveAsTable("analytics.more")
    assert imported.listed("analytics")["more"].count() == 4
    assert {d.name for d in spark.catalog.listDatabases()} >= set(LAYERS)


def test_names():
    assert Warehouse.names("src") == sorted(SOURCE_SCHEMAS)
    assert Warehouse.names("analytics") == sorted(MODEL_KEYS)
    assert len(Warehouse.names("reporting")) == 7


def test_one_warehouse_per_file_state(spark, tmp_path):
    import shutil

    small = tmp_path / "tables"
    shutil.copytree(TESTDATA / "sf0.001", small)
    first = open_testbed(spark, str(small))
    assert open_testbed(spark, str(small)) is first
    assert first.source("distribution_centers").count() == 10
    target = small / "supplier.parquet"
    target.chmod(0o644)
    shutil.copyfile(TESTDATA / "sf0.01" / "supplier.parquet", target)
    second = open_testbed(spark, str(small))
    assert second is not first
    assert second.source("distribution_centers").count() == 100


class _Cluster:
    """Just enough of a session to name its master and settings."""

    class sparkContext:  # noqa: N801
        master = "yarn"

        @staticmethod
        def getConf():
            return {}

    class conf:  # noqa: N801
        @staticmethod
        def get(name, default=None):
            return default


def test_a_cluster_needs_a_shared_folder(spark):
    assert shared_folder(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(_Cluster)


def test_cutoff_is_a_parameter(spark, folder, tmp_path):
    early = Warehouse.from_csv(spark, folder, dt.date(2022, 1, 1), CUTOFF, root=f"{tmp_path}/early")
    assert values(early.report("order_fulfilment"), "order_id") == []


def test_command_line(spark, folder, tmp_path):
    from haberdash.__main__ import main

    main(["--csv", folder, "--store", f"{tmp_path}/store", "--out", f"{tmp_path}/results",
          "row_counts_src", "annual_performance"])
    assert spark.read.parquet(f"{tmp_path}/results/row_counts_src").count() == 7
    assert spark.read.parquet(f"{tmp_path}/results/annual_performance").count() == 0
    with pytest.raises(SystemExit):
        main(["--csv", folder, "--out", f"{tmp_path}/results", "no_such_query"])
