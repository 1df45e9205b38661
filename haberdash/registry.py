"""Every query by name, as a function of a warehouse."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haberdash.operators.keys import duplicate_keys, key_violations, stacked
from haberdash.plans import (
    cleaned,
    customers,
    funnel,
    headline,
    logistics,
    model,
    products,
    profiling,
    quality,
    relations,
    reporting,
    sales,
)
from haberdash.sources.schemas import MODEL_KEYS, SOURCE_KEYS, SOURCE_SCHEMAS
from haberdash.sources.warehouse import LAYERS, Warehouse

Query = Callable[[Warehouse], DataFrame]

SOURCES = tuple(SOURCE_SCHEMAS)


def _listing(layer: str) -> Query:
    """The relations that the catalog lists for a layer, each counted to show that it answers."""
    return lambda w: profiling.row_counts(w.listed(layer)).orderBy("table_name")


def _titled(w: Warehouse) -> dict[str, DataFrame]:
    return {name.capitalize(): w.source(name) for name in SOURCES}


def _layer_census(w: Warehouse) -> DataFrame:
    """Makes the layers' databases and counts what the catalog then lists in each."""
    return stacked(
        profiling.row_counts(w.listed(layer))
        .agg(F.count("*").alias("relations"), F.sum("row_count").alias("row_count"))
        .select(F.lit(layer).alias("layer"), "relations", "row_count")
        for layer in LAYERS
    )


def _rebuilt(w: Warehouse) -> DataFrame:
    w.rebuild_model()
    return profiling.row_counts({name: w.model(name) for name in MODEL_KEYS})


def _materialised(w: Warehouse) -> DataFrame:
    return stacked(
        w.model(name)
        .agg(F.count("*").alias("row_count"), F.countDistinct(key).alias("key_count"))
        .select(F.lit(name).alias("table_name"), "row_count", "key_count")
        for name, key in MODEL_KEYS.items()
    )


def _session_cache(w: Warehouse) -> DataFrame:
    flags = list(funnel.STEPS)
    return w.session_flags().groupBy(*flags).agg(F.count("*").alias("sessions")).orderBy(*flags)


LAYER_QUERIES: dict[str, Query] = {
    "load_csv": lambda w: profiling.content_report(w.all_reimported()),
    "create_layers": _layer_census,
    "row_counts_src": lambda w: profiling.row_counts(_titled(w)),
    "schema_report": lambda w: profiling.column_report(
        {n: w.source(n) for n in SOURCES}, SOURCE_KEYS
    ),
    "pk_assert": lambda w: key_violations(
        {"distribution_centers": (w.source("distribution_centers"), "id")}
    ),
    "list_cleaned": _listing("cleaned"),
    "rebuild_model": _rebuilt,
    "materialise": _materialised,
    "pk_assert_model": lambda w: key_violations({n: (w.model(n), k) for n, k in MODEL_KEYS.items()}),
    "list_analytics": _listing("analytics"),
    "row_counts_model": lambda w: profiling.row_counts({n: w.model_plan(n) for n in MODEL_KEYS}),
    "session_cache": _session_cache,
    "list_reporting": _listing("reporting"),
    "sales_monthly_preview": lambda w: reporting.sales_monthly_preview(w.report("sales_monthly")),
    **{
        f"preview_{name}": (lambda w, n=name: profiling.preview(w.source(n), SOURCE_KEYS[n]))
        for name in SOURCES
    },
}

PROFILING_QUERIES: dict[str, Query] = {
    "dup_keys": lambda w: duplicate_keys(
        {n.capitalize(): (w.source(n), SOURCE_KEYS[n]) for n in SOURCES}
    ),
    "missing_users": lambda w: profiling.missing(
        w.source("users"),
        id="id",
        created_at="created_at",
        country="country",
        traffic_source="traffic_source",
    ),
    "missing_products": lambda w: profiling.missing(
        w.source("products"),
        id="id",
        category="category",
        cost="cost",
        retail_price="retail_price",
        distribution_center_id="distribution_center_id",
    ),
    "missing_orders": lambda w: profiling.missing(
        w.source("orders"),
        order_id="order_id",
        user_id="user_id",
        status="status",
        created_at="created_at",
        item_count="num_of_item",
    ),
    "missing_order_items": lambda w: profiling.missing(
        w.source("order_items"),
        id="id",
        order_id="order_id",
        user_id="user_id",
        product_id="product_id",
        inventory_item_id="inventory_item_id",
        status="status",
        created_at="created_at",
        sale_price="sale_price",
    ),
    "missing_inventory": lambda w: profiling.missing(
        w.source("inventory_items"),
        id="id",
        product_id="product_id",
        created_at="created_at",
        cost="cost",
        category="product_category",
        retail_price="product_retail_price",
        distribution_center_id="product_distribution_center_id",
    ),
    "missing_events": lambda w: profiling.missing(
        w.source("events"),
        id="id",
        session_id="session_id",
        sequence_number="sequence_number",
        created_at="created_at",
        event_type="event_type",
        traffic_source="traffic_source",
    ),
    "date_coverage": lambda w: profiling.date_coverage(
        {
            n: w.source_columns(n, "created_at")
            for n in ("users", "orders", "inventory_items", "events")
        }
    ),
    "freq_order_status": lambda w: profiling.frequencies(w.source("orders"), "status", "order_count"),
    "freq_event_type": lambda w: profiling.frequencies(w.source("events"), "event_type", "event_count"),
    "freq_country": lambda w: profiling.frequencies(w.source("users"), "country", "customer_count"),
    "freq_traffic_source": lambda w: profiling.frequencies(
        w.source("users"), "traffic_source", "customer_count"
    ),
    "freq_category": lambda w: profiling.frequencies(w.source("products"), "category", "product_count"),
    "range_age": lambda w: profiling.value_range(w.source("users"), {"age": F.col("age")}),
    "range_product_price": lambda w: profiling.value_range(
        w.source("products"),
        {c: F.col(c).cast("decimal(12,2)") for c in ("cost", "retail_price")},
    ),
    "range_sale_price": lambda w: profiling.value_range(
        w.source("order_items"), {"sale_price": F.col("sale_price").cast("decimal(12,2)")}
    ),
    "range_item_count": lambda w: profiling.value_range(
        w.source("orders"), {"items": F.col("num_of_item")}
    ),
}

RELATION_QUERIES: dict[str, Query] = {
    "orphan_census": lambda w: relations.orphan_census(w.source),
    "mismatch_customer": lambda w: relations.mismatched_customers(
        w.source("order_items"), w.source("orders")
    ),
    "mismatch_status": lambda w: relations.mismatched_statuses(
        w.source("order_items"), w.source("orders")
    ),
    "mismatch_item_count": lambda w: relations.mismatched_item_counts(
        w.source("order_items"), w.source("orders")
    ),
    "mismatch_product": lambda w: relations.mismatched_products(
        w.source("order_items"), w.source("inventory_items")
    ),
    "mismatch_center": lambda w: relations.mismatched_centers(
        w.source("inventory_items"), w.source("products")
    ),
}

QUALITY_QUERIES: dict[str, Query] = {
    **{
        check: (lambda w, c=check: quality.violations(w.source, c)) for check in quality.RULES
    },
    "sold_before_created": lambda w: quality.violations(
        lambda relation: w.source_columns(relation, "created_at", "sold_at"), "sold_before_created"
    ),
    "quality_scorecard": lambda w: quality.scorecard(w.source),
    "blank_products_by_column": lambda w: quality.blank_products_by_column(w.source("products")),
    "worst_ship_gaps": lambda w: quality.worst_ship_gaps(w.source("order_items")),
    "dup_session_sequence": lambda w: quality.duplicate_session_sequences(w.session_profile()),
    "session_gaps": lambda w: quality.session_gaps(w.session_profile()),
    "country_variants": lambda w: cleaned.country_spellings(w.source("users")),
    "session_multi_attr": lambda w: quality.inconsistent_sessions(w.session_profile()),
}

CLEANED_QUERIES: dict[str, Query] = {
    "clean_users": lambda w: w.cleaned("users"),
    "clean_products": lambda w: w.cleaned("products"),
    "clean_orders": lambda w: w.cleaned("orders"),
    "clean_order_items": lambda w: w.cleaned("order_items"),
    "clean_inventory": lambda w: w.cleaned("inventory_items"),
    "clean_centers": lambda w: w.cleaned("distribution_centers"),
    "clean_events": lambda w: w.cleaned("events"),
    "country_post_check": lambda w: cleaned.country_spellings(w.cleaned("users")),
}

MODEL_QUERIES: dict[str, Query] = {
    **{name: (lambda w, n=name: w.model(n)) for name in MODEL_KEYS},
    "flagged_revenue_share": lambda w: model.flagged_revenue_share(
        w.model_plan("fact_order_items"), w.sales_cutoff
    ),
}


def _over(build: Callable[..., DataFrame], *tables: str) -> Query:
    """A sales or stock report over model tables, up to the sales cutoff.

    Orders and stock are projections of their relation and not written for it.
    """
    return lambda w: build(
        *(w.model_plan(t) if t in (ORDERS, STOCK) else w.model(t) for t in tables), w.sales_cutoff
    )


def _over_orders(build: Callable[..., DataFrame], *tables: str) -> Query:
    """A report over the stored sales per customer and order."""
    return lambda w: build(w.customer_orders(), *(w.model(t) for t in tables))


def _over_products(build: Callable[..., DataFrame], *tables: str) -> Query:
    """A report over the stored items per product."""
    return lambda w: build(w.working("product_items"), *(w.model(t) for t in tables))


def _over_sessions(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda w: build(w.session_flags())


ITEMS, ORDERS, STOCK = "fact_order_items", "fact_orders", "fact_inventory"
PRODUCTS, CUSTOMERS, CENTERS = "dim_product", "dim_customer", "dim_distribution_center"

ANALYSIS_QUERIES: dict[str, Query] = {
    "item_statuses": lambda w: sales.item_statuses(w.model(ITEMS)),
    "overall_kpis": _over_orders(sales.overall_kpis),
    "annual_performance": _over_orders(sales.annual_performance),
    "monthly_trend": _over(sales.monthly_trend, ITEMS),
    "yoy_growth": _over(sales.yoy_growth, ITEMS),
    "aov_by_year": _over(sales.order_value_by_year, ITEMS),
    "category_performance": _over_products(products.category_performance, PRODUCTS),
    "brand_performance": _over_products(products.brand_performance, PRODUCTS),
    "top_products": _over_products(products.top_products, PRODUCTS),
    "product_rank_in_category": lambda w: products.rank_in_category(
        w.working("product_items"), w.model(PRODUCTS), w.keeper(ITEMS, PRODUCTS)
    ),
    "high_revenue_low_margin": _over_products(products.high_revenue_low_margin, PRODUCTS),
    "highest_return_rates": _over_products(products.highest_return_rates, PRODUCTS),
    "lost_value": _over(products.lost_value, ITEMS),
    "items_per_product_histogram": _over_products(products.items_per_product_histogram),
    "one_time_vs_repeat": _over_orders(customers.one_time_vs_repeat),
    "new_vs_repeat_by_year": _over(customers.new_vs_repeat_by_year, ITEMS),
    "order_frequency": _over_orders(customers.order_frequency),
    "by_country": _over_orders(customers.by_country, CUSTOMERS),
    "by_acquisition_source": _over_orders(customers.by_acquisition_source, CUSTOMERS),
    "by_age_group": _over_orders(customers.by_age_group, CUSTOMERS),
    "by_gender": _over_orders(customers.by_gender, CUSTOMERS),
    "purchase_sequence": _over_orders(customers.purchase_sequence),
    "event_types": lambda w: funnel.event_types(w.model("fact_events"), w.event_cutoff),
    "session_flags": lambda w: w.session_flags(),
    "cart_without_product": _over_sessions(funnel.cart_without_product),
    "purchase_without_cart": _over_sessions(funnel.purchase_without_cart),
    "funnel_overall": _over_sessions(funnel.funnel_overall),
    "funnel_by_source": _over_sessions(funnel.funnel_by_source),
    "funnel_by_browser": _over_sessions(funnel.funnel_by_browser),
    "funnel_monthly": _over_sessions(funnel.funnel_monthly),
    "logistics_overall": _over(logistics.logistics_overall, ORDERS),
    "logistics_by_year": _over(logistics.logistics_by_year, ORDERS),
    "logistics_by_center": lambda w: logistics.logistics_by_center(
        w.working("center_orders"), w.model(CENTERS)
    ),
    "inventory_overall": _over(logistics.inventory_overall, STOCK),
    "inventory_by_center": _over(logistics.inventory_by_center, STOCK, CENTERS),
    "inventory_aging": _over(logistics.inventory_aging, STOCK),
    "slow_movers": _over(logistics.slow_movers, STOCK, PRODUCTS),
    "inventory_by_year": _over(logistics.inventory_by_year, STOCK),
}

REPORT_QUERIES: dict[str, Query] = {
    **{name: (lambda w, n=name: w.report(n)) for name in reporting.VIEWS},
    "headline_sales": lambda w: headline.headline_sales(w.report("sales_monthly")),
    "cart_abandonment": lambda w: headline.cart_abandonment(w.report("session_funnel")),
    "returning_share": lambda w: headline.returning_share(w.report("customer_yearly")),
    "source_concentration": lambda w: headline.source_concentration(w.report("customer_performance")),
    "customers_per_age": lambda w: headline.customers_per_age(w.report("customer_performance")),
    "category_vs_average_margin": lambda w: headline.category_vs_average_margin(
        w.report("product_performance")
    ),
    "unsold_capital": lambda w: headline.unsold_capital(w.report("distribution_center_performance")),
    "order_count_trio": lambda w: headline.order_count_trio(
        w.working("center_orders"), w.model(CENTERS)
    ),
}

QUERIES: dict[str, Query] = {
    **LAYER_QUERIES,
    **PROFILING_QUERIES,
    **RELATION_QUERIES,
    **QUALITY_QUERIES,
    **CLEANED_QUERIES,
    **MODEL_QUERIES,
    **ANALYSIS_QUERIES,
    **REPORT_QUERIES,
}
