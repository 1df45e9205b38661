"""The seven raw relations derived from order-shaped Parquet test tables.

``customer nation supplier part orders lineitem events`` are recast as a clothing
retailer's raw export, with blanks, spelling variants, missing values and
impossible dates worked in by fixed rules on the keys. Every input row is used.
"""

from __future__ import annotations

import datetime as dt
import threading
from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from haberdash.functions.columns import PRICE
from haberdash.operators import skew
from haberdash.operators.numbering import numbered, sliced, totals_before
from haberdash.operators.sizes import sized, too_large
from haberdash.sources.files import fingerprints
from haberdash.sources.schemas import SOURCE_SCHEMAS
from haberdash.sources.warehouse import Store, Warehouse, digest, own_store

SALES_CUTOFF = dt.date(2001, 8, 1)
EVENT_CUTOFF = dt.date(2024, 1, 30)

TABLES = ("customer", "nation", "supplier", "part", "orders", "lineitem", "events")
# The tables that each raw relation is made of.
MADE_OF = {
    "users": ("customer", "nation"),
    "products": ("part",),
    "orders": ("orders",),
    "order_items": ("lineitem", "orders"),
    "inventory_items": ("lineitem", "orders", "part"),
    "distribution_centers": ("supplier",),
    "events": ("events",),
}

PRODUCT_TEXTS = frozenset(
    f"product_{text}" for text in ("category", "name", "brand", "department", "sku")
)

# Each part has this many unsold pieces; piece n lies in center n.
UNSOLD_PIECES = 10

BLANK = "  "

LINE_ORDER = (
    "l_linenumber",
    "l_partkey",
    "l_suppkey",
    "l_shipdate",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
    "l_returnflag",
    "l_linestatus",
)


def _choose(key: Column, cases: dict[int, Column], otherwise: Column) -> Column:
    result = otherwise
    for value, column in reversed(cases.items()):
        result = F.when(key == value, column).otherwise(result)
    return result


def _money(amount: Column) -> Column:
    return amount.cast(PRICE)


def _cost_share(key: Column) -> Column:
    """Cost as a fraction of the price: 30 to 69 percent."""
    return (F.lit(30) + key % 40).cast("decimal(4,0)") * F.lit("0.01").cast("decimal(3,2)")


def _gender(customer: Column) -> Column:
    return F.when(customer % 2 == 0, "F").otherwise("M")


def _fitted(frame: DataFrame, relation: str) -> DataFrame:
    """The declared columns in order and type; a column not derived is NULL."""
    fields = [field.strip().split(" ") for field in SOURCE_SCHEMAS[relation].split(",")]
    return frame.select(
        *(
            (F.col(name) if name in frame.columns else F.lit(None)).cast(kind).alias(name)
            for name, kind in fields
        )
    )


class Testbed:
    """Builds raw relations from the test tables in ``folder``."""

    # Plain projections of files that are Parquet already.
    in_place = ("products", "orders", "order_items", "distribution_centers")

    def __init__(self, store: Store, folder: str) -> None:
        self.store = store
        self._schemas: dict[str, StructType] = {}
        self.folder = folder.rstrip("/")
        self._files: dict[str, str] = {}

    def states(self) -> dict[str, str]:
        """The state of the files behind each raw relation, as they are now."""
        self._files = fingerprints(self.store.spark, {t: f"{self.folder}/{t}.parquet" for t in TABLES})
        self._schemas.clear()
        return {relation: self._state(*tables) for relation, tables in MADE_OF.items()}

    def _state(self, *tables: str) -> str:
        return digest(*(self._files[t] for t in tables))

    def __call__(self, relation: str) -> DataFrame:
        return _fitted(getattr(self, relation)(), relation)

    def columns(self, relation: str, names: Collection[str]) -> DataFrame:
        """Some columns of a raw relation, all rows; stock items without texts need no products."""
        if relation == "inventory_items" and not PRODUCT_TEXTS & set(names):
            return _fitted(self.inventory_items(texts=False), relation).select(*names)
        return self(relation).select(*names)

    def _read(self, table: str) -> DataFrame:
        path, read = f"{self.folder}/{table}.parquet", self.store.spark.read
        if table not in self._schemas:
            self._schemas[table] = read.parquet(path).schema
        return read.schema(self._schemas[table]).parquet(path)

    def users(self) -> DataFrame:
        key, nation = F.col("c_custkey"), F.col("n_nationkey")
        country = _choose(
            nation % 8,
            {
                0: F.lit("Germany"),
                1: F.lit("Deutschland"),
                2: F.lit(" España"),
                3: F.lit("Spain "),
                4: F.lit("Brasil"),
                5: F.lit("Brazil"),
                6: F.lit(BLANK),
            },
            F.col("n_name"),
        )
        return (
            self._read("customer")
            .join(self._read("nation"), F.col("c_nationkey") == nation, "left")
            .select(
                key.alias("id"),
                F.concat(F.lit(" "), "c_name", F.lit(" ")).alias("first_name"),
                F.concat(F.lit("c"), key.cast("string"), F.lit("@x.test")).alias("email"),
                F.when(key % 301 == 0, F.lit(None))
                .when(key % 302 == 0, -1)
                .otherwise(12 + key % 59)
                .alias("age"),
                _gender(key).alias("gender"),
                F.col("n_name").alias("state"),
                F.lit(BLANK).alias("street_address"),
                F.col("n_name").alias("city"),
                country.alias("country"),
                nation.alias("latitude"),
                F.col("c_acctbal").alias("longitude"),
                F.col("c_mktsegment").alias("traffic_source"),
                F.date_add(F.lit(dt.date(1993, 1, 1)), (key % 700).cast("int")).alias("created_at"),
            )
        )

    def products(self) -> DataFrame:
        key, price = F.col("p_partkey"), _money(F.col("p_retailprice"))
        return self._read("part").select(
            key.alias("id"),
            F.when(key % 101 == 0, _money(price + 1))
            .otherwise(_money(price * _cost_share(key)))
            .alias("cost"),
            F.col("p_type").alias("category"),
            F.col("p_name").alias("name"),
            _choose(
                key % 83,
                {0: F.lit(None).cast("string"), 1: F.lit(BLANK)},
                F.concat("p_brand", F.lit(" ")),
            ).alias("brand"),
            price.alias("retail_price"),
            F.when(F.col("p_size") <= 25, "Men").otherwise("Women").alias("department"),
            F.concat(F.lit("SKU-"), key.cast("string")).alias("sku"),
            (key % 10).alias("distribution_center_id"),
        )

    def orders(self) -> DataFrame:
        key, state = F.col("o_orderkey"), F.col("o_orderstatus")
        status = F.col("status")
        day = F.to_date("o_orderdate")

        def later(days: Column) -> Column:
            return F.date_add(day, days.cast("int"))

        return (
            self._read("orders")
            .withColumn(
                "status",
                F.when(key % 499 == 0, BLANK)
                .when(state == "O", "Shipped")
                .when((state == "F") & (key % 3 == 0), "Returned")
                .when(state == "F", "Complete")
                .when(F.col("o_orderpriority").isin("4-NOT SPECIFIED", "5-LOW"), "Cancelled")
                .otherwise("Processing"),
            )
            .select(
                key.alias("order_id"),
                F.col("o_custkey").alias("user_id"),
                status,
                _gender(F.col("o_custkey")).alias("gender"),
                F.col("o_orderdate").alias("created_at"),
                F.when(status == "Returned", later(key % 4 + 2 + key % 5 + key % 3)).alias(
                    "returned_at"
                ),
                F.when(status.isin("Shipped", "Complete", "Returned"), later(key % 4)).alias(
                    "shipped_at"
                ),
                F.when(status.isin("Complete", "Returned"), later(key % 4 + 1 + key % 5)).alias(
                    "delivered_at"
                ),
                (key % 7).alias("num_of_item"),
            )
        )

    def _lines(self) -> DataFrame:
        """Order lines, numbered through in the order of their order, with its details.

        Stored, because items and sold stock are both cut from it. A line's number is its
        place in its order after the lines of all earlier orders, so lines move once, to
        their order. Only the lines of orders too large for a task are numbered in slices.
        """
        key = F.col("l_orderkey")
        # Lines alike in every column are told apart by where they are stored.
        order = [*LINE_ORDER, "_file", "_row"]
        placed = self._read("lineitem").select(
            "*",
            F.xxhash64("_metadata.file_path").alias("_file"),
            F.col("_metadata.row_index").alias("_row"),
        )
        sizes = self.store.table(
            "import/order_sizes",
            lambda: sliced(
                placed.groupBy("l_orderkey").agg(F.count("*").alias("_lines")), [], ["l_orderkey"]
            ),
            self._state("lineitem"),
        )
        starts = totals_before(sizes, ["l_orderkey"], "_lines", "_start").select(
            key.alias("_order"), "_start"
        )
        if too_large(sizes.select("l_orderkey", "_lines")):
            starts = starts.hint("merge")
        orders = sized(self("orders"))

        def keyed(lines: DataFrame) -> DataFrame:
            # Lines without an order come first: nothing is before them.
            return (
                lines.join(starts, key == F.col("_order"), "left")
                .join(orders, key == F.col("order_id"), "left")
                .withColumn("line_key", F.coalesce("_start", F.lit(0)) + F.col("_place"))
            )

        inside = Window.partitionBy("l_orderkey").orderBy(*order)
        place = F.row_number().over(inside).cast("bigint")
        large = self._large_orders(sizes)
        if not large:
            lines = keyed(placed.withColumn("_place", place))
        else:
            is_large = key.isin([o for o in large if o is not None])
            is_large = F.coalesce(is_large, F.lit(None in large))
            slices = self.store.table(
                "import/large_orders",
                lambda: sliced(placed.where(is_large), ["l_orderkey"], order),
                self._state("lineitem"),
            )
            lines = keyed(placed.where(~is_large).withColumn("_place", place)).unionByName(
                keyed(numbered(slices, ["l_orderkey"], order, position="_place"))
            )
        return lines.select(
            "line_key",
            key.alias("order_id"),
            "user_id",
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("center_id"),
            F.col("l_quantity").cast("int").alias("quantity"),
            "status",
            "created_at",
            F.when((F.col("l_returnflag") == "R") & (F.col("status") == "Complete"), "Returned")
            .otherwise(F.col("status"))
            .alias("line_status"),
            F.when(F.col("shipped_at").isNotNull(), F.col("l_shipdate")).alias("shipped_at"),
            F.when(F.col("l_linestatus") == "F", F.col("delivered_at")).alias("delivered_at"),
            "returned_at",
            _money(F.col("l_extendedprice")).alias("sale_price"),
        )

    def _large_orders(self, sizes: DataFrame) -> list[int | None]:
        """Orders, or lines without one, with more lines than one task should take; at most 1 / SHARE."""
        total = sizes.agg(F.sum("_lines")).first()[0] or 0
        limit = max(total * skew.SHARE, skew.LEAST_ROWS)
        return [r["l_orderkey"] for r in sizes.where(F.col("_lines") > limit).collect()]

    def _stored_lines(self) -> DataFrame:
        return self.store.table("import/lines", self._lines, self._state("lineitem", "orders"))

    def order_items(self) -> DataFrame:
        return self._stored_lines().select(
            F.col("line_key").alias("id"),
            "order_id",
            "user_id",
            "product_id",
            F.col("line_key").alias("inventory_item_id"),
            F.col("line_status").alias("status"),
            "created_at",
            "shipped_at",
            "delivered_at",
            "returned_at",
            "sale_price",
        )

    def _repeated_products(self) -> DataFrame:
        """The ids of products that are there more than once, as often as they are.

        Stored, so its size is known before a join: few or none as a rule.
        """
        ids = self("products").select(F.col("id").alias("product_id"))
        repeated = ids.groupBy("product_id").agg(F.count("*").alias("_times")).where("_times > 1")
        return self.store.table(
            "import/repeated_products",
            lambda: ids.join(repeated, "product_id", "left_semi"),
            self._state("part"),
        )

    def inventory_items(self, texts: bool = True) -> DataFrame:
        """A stock item for every order line, and the unsold pieces of every part.

        The texts of its product are looked up for each line, once for each time the product
        is there. Without ``texts`` only products that are there more than once matter.
        """
        products = self("products").select(
            F.col("id").alias("product_id"),
            F.col("category").alias("product_category"),
            F.col("name").alias("product_name"),
            F.col("brand").alias("product_brand"),
            F.col("department").alias("product_department"),
            F.col("sku").alias("product_sku"),
            _money(F.col("retail_price")).alias("list_price"),
        )
        if not texts:
            products = products.drop(*PRODUCT_TEXTS)
        repeated = sized(products) if texts else self._repeated_products()
        kept = [name for name in products.columns if name != "list_price"]
        day = F.to_date("created_at")
        sold = (
            self._stored_lines()
            .join(repeated.drop("list_price"), "product_id", "left")
            .select(
                F.col("line_key").alias("id"),
                *kept,
                F.date_sub(day, F.col("quantity")).alias("created_at"),
                day.alias("sold_at"),
                _money(F.col("sale_price") * _cost_share(F.col("product_id"))).alias("cost"),
                F.col("sale_price").alias("product_retail_price"),
                F.col("center_id").alias("product_distribution_center_id"),
            )
        )
        piece, product = F.col("piece"), F.col("product_id")
        unsold = products.withColumn(
            "piece", F.explode(F.sequence(F.lit(0), F.lit(UNSOLD_PIECES - 1)))
        ).select(
            (-(product * 10 + piece + 1)).alias("id"),
            *kept,
            F.date_add(
                F.lit(dt.date(1998, 2, 1)), ((product * 7 + piece * 131) % 1300).cast("int")
            ).alias("created_at"),
            F.lit(None).cast("date").alias("sold_at"),
            _money(F.col("list_price") * F.lit("0.5").cast("decimal(2,1)")).alias("cost"),
            F.col("list_price").alias("product_retail_price"),
            piece.cast("bigint").alias("product_distribution_center_id"),
        )
        return sold.unionByName(unsold)

    def distribution_centers(self) -> DataFrame:
        return self._read("supplier").select(
            F.col("s_suppkey").alias("id"),
            F.col("s_name").alias("name"),
            F.col("s_nationkey").alias("latitude"),
            F.col("s_acctbal").alias("longitude"),
        )

    def events(self) -> DataFrame:
        key, user = F.col("event_id"), F.col("user_id")
        days = self._read("events").withColumn("day", F.to_date("ts"))
        keys, order = ["user_id", "day"], ["ts", "event_id"]
        slices = self.store.table(
            "import/event_slices", lambda: sliced(days, keys, order), self._state("events")
        )
        steps = numbered(slices, keys, order)
        kind = F.col("event_type")
        return steps.select(
            key.alias("id"),
            user,
            F.when(key % 307 == 0, 0).otherwise(F.col("position")).alias("sequence_number"),
            F.when(
                key % 211 != 0, F.concat_ws("-", user.cast("string"), F.col("day").cast("string"))
            ).alias("session_id"),
            F.col("ts").alias("created_at"),
            F.when(user % 2 == 0, "Chrome").otherwise("Safari").alias("browser"),
            F.when(key % 97 == 0, "Direct")
            .otherwise(
                _choose(user % 3, {0: F.lit("Search"), 1: F.lit("Email")}, F.lit("Facebook"))
            )
            .alias("traffic_source"),
            F.col("props").alias("uri"),
            _choose(
                kind,
                {
                    "view": F.lit("product"),
                    "click": F.lit("cart"),
                    "signup": F.lit("home"),
                    "error": F.lit("cancel"),
                },
                kind,
            ).alias("event_type"),
        )


_open: dict[tuple[str, str, str], Warehouse] = {}
_opening = threading.Lock()


def warehouse_over(store: Store, folder: str) -> Warehouse:
    """The tables in ``folder`` as a warehouse."""
    load = Testbed(store, folder)
    return Warehouse(store, load, SALES_CUTOFF, EVENT_CUTOFF, load.in_place, load.states, load_columns=load.columns)


def open_testbed(spark: SparkSession, folder: str) -> Warehouse:
    """The warehouse over the test tables in ``folder``, one per session and file state."""
    application = spark.sparkContext.applicationId
    with _opening:
        paths = {table: f"{folder.rstrip('/')}/{table}.parquet" for table in TABLES}
        key = (application, folder, digest(*sorted(fingerprints(spark, paths).items())))
        if key not in _open:
            _open[key] = warehouse_over(own_store(spark, None, paths.values()), folder)
    return _open[key]
