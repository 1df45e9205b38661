"""One SQL statement per query name."""

from __future__ import annotations

from haberdash.sources.schemas import MODEL_KEYS
from oracle.arithmetic import (
    mean2,
    mean6,
    money_growth,
    money_percent,
    money_ratio,
    percent,
    quotient,
)
from oracle.relations import BAD_DATES, EVENT_CUTOFF, SALES_CUTOFF, with_relations

# The raw relations, their columns and types.
_DECLARED = {
    "users": (
        "id bigint, first_name string, last_name string, email string, age int, gender string, "
        "state string, street_address string, postal_code string, city string, country string, "
        "latitude double, longitude double, traffic_source string, created_at timestamp_ntz"
    ),
    "products": (
        "id bigint, cost double, category string, name string, brand string, "
        "retail_price double, department string, sku string, distribution_center_id bigint"
    ),
    "orders": (
        "order_id bigint, user_id bigint, status string, gender string, "
        "created_at timestamp_ntz, returned_at timestamp_ntz, shipped_at timestamp_ntz, "
        "delivered_at timestamp_ntz, num_of_item int"
    ),
    "order_items": (
        "id bigint, order_id bigint, user_id bigint, product_id bigint, "
        "inventory_item_id bigint, status string, created_at timestamp_ntz, "
        "shipped_at timestamp_ntz, delivered_at timestamp_ntz, returned_at timestamp_ntz, "
        "sale_price double"
    ),
    "inventory_items": (
        "id bigint, product_id bigint, created_at timestamp_ntz, sold_at timestamp_ntz, "
        "cost double, product_category string, product_name string, product_brand string, "
        "product_retail_price double, product_department string, product_sku string, "
        "product_distribution_center_id bigint"
    ),
    "distribution_centers": (
        "id bigint, name string, latitude double, longitude double"
    ),
    "events": (
        "id bigint, user_id bigint, sequence_number bigint, session_id string, "
        "created_at timestamp_ntz, ip_address string, city string, state string, "
        "postal_code string, browser string, traffic_source string, uri string, "
        "event_type string"
    ),
}
COLUMNS = {name: [tuple(f.split(" ")) for f in text.split(", ")] for name, text in _DECLARED.items()}
KEYS = {
    "users": "id",
    "products": "id",
    "orders": "order_id",
    "order_items": "id",
    "inventory_items": "id",
    "distribution_centers": "id",
    "events": "id",
}
SOURCES = tuple(COLUMNS)
NET = "sum(kept_revenue)::DECIMAL(38,2) AS net_revenue, sum(kept_profit)::DECIMAL(38,2) AS gross_profit"
MARGIN = f"{money_percent('gross_profit', 'net_revenue')} AS gross_margin_percent"
ORDER_VALUE = f"{money_ratio('net_revenue', 'valid_orders')} AS average_order_value"
RETURN_RATE = f"{percent('returned_items', 'total_items')} AS return_rate_percent"


def union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def counts(tables: dict[str, str]) -> str:
    return union(
        f"SELECT '{label}' AS table_name, count(*) AS row_count FROM {table}"
        for label, table in tables.items()
    )


# -- reports, also read by the headline figures ------------------------------

REPORTS: dict[str, str] = {
    "sales_monthly": f"""
SELECT order_year, order_month, valid_orders, total_customers, total_orders, valid_items, returned_items,
  cancelled_orders, cancelled_items, net_revenue, gross_profit, returned_revenue_value,
  cancelled_revenue_value, {MARGIN}, {ORDER_VALUE},
  {percent('returned_items', 'valid_items')} AS return_rate_percent
FROM (
  SELECT order_year, order_month,
    count(DISTINCT order_id) FILTER (NOT called_off) AS valid_orders,
    count(DISTINCT customer_id) FILTER (NOT called_off) AS total_customers,
    count(DISTINCT order_id) AS total_orders,
    count(*) FILTER (NOT called_off) AS valid_items,
    count(*) FILTER (came_back) AS returned_items,
    count(DISTINCT order_id) FILTER (called_off) AS cancelled_orders,
    count(*) FILTER (called_off) AS cancelled_items,
    coalesce(sum(item_revenue) FILTER (NOT called_off AND NOT came_back), 0)::DECIMAL(38,2) AS net_revenue,
    coalesce(sum(gross_profit_before_returns) FILTER (NOT called_off AND NOT came_back), 0)::DECIMAL(38,2)
      AS gross_profit,
    coalesce(sum(item_revenue) FILTER (came_back), 0)::DECIMAL(38,2) AS returned_revenue_value,
    coalesce(sum(item_revenue) FILTER (called_off), 0)::DECIMAL(38,2) AS cancelled_revenue_value
  FROM period_items GROUP BY ALL)
WHERE valid_items > 0""",
    "product_performance": f"""
SELECT p.product_id, coalesce(product_name, 'Unknown product') AS product_name,
  coalesce(category, 'Unknown category') AS category, coalesce(brand, 'Unknown brand') AS brand,
  coalesce(department, 'Unknown department') AS department, retail_price,
  coalesce(n, 0) AS ordered_items, coalesce(n_valid, 0) AS valid_items, coalesce(n_back, 0) AS returned_items,
  coalesce(n_off, 0) AS cancelled_items, coalesce(rev, 0)::DECIMAL(38,2) AS net_revenue,
  coalesce(prof, 0)::DECIMAL(38,2) AS gross_profit, coalesce(rev_back, 0)::DECIMAL(38,2) AS returned_revenue_value,
  coalesce(rev_off, 0)::DECIMAL(38,2) AS cancelled_revenue_value,
  coalesce(n_stock, 0) AS total_inventory_items, coalesce(n_sold, 0) AS sold_items,
  coalesce(n_stock - n_sold, 0) AS unsold_items, coalesce(cost_left, 0)::DECIMAL(38,2) AS unsold_inventory_cost,
  coalesce(n_old, 0) AS unsold_items_180_plus_days, coalesce(cost_old, 0)::DECIMAL(38,2) AS old_inventory_cost,
  if(n_stock > n_sold, {mean2('age_sum', 'n_stock - n_sold')}, NULL) AS average_unsold_age_days,
  {money_percent('prof', 'rev')} AS gross_margin_percent,
  {percent('n_back', 'n_valid')} AS return_rate_percent,
  {percent('n_off', 'n')} AS cancellation_rate_percent,
  {percent('n_sold', 'n_stock')} AS sell_through_rate_percent
FROM dim_product AS p
LEFT JOIN (
  SELECT product_id, count(*) AS n, count(*) FILTER (NOT called_off) AS n_valid,
    count(*) FILTER (came_back) AS n_back, count(*) FILTER (called_off) AS n_off,
    coalesce(sum(item_revenue) FILTER (NOT called_off AND NOT came_back), 0) AS rev,
    coalesce(sum(gross_profit_before_returns) FILTER (NOT called_off AND NOT came_back), 0) AS prof,
    sum(item_revenue) FILTER (came_back) AS rev_back, sum(item_revenue) FILTER (called_off) AS rev_off
  FROM period_items GROUP BY ALL) AS s USING (product_id)
LEFT JOIN (
  SELECT product_id, count(*) AS n_stock, count(*) FILTER (sold) AS n_sold,
    sum(inventory_cost) FILTER (NOT sold) AS cost_left,
    count(*) FILTER (NOT sold AND age_days >= 180) AS n_old,
    sum(inventory_cost) FILTER (NOT sold AND age_days >= 180) AS cost_old,
    sum(age_days) FILTER (NOT sold) AS age_sum
  FROM stock GROUP BY ALL) AS i USING (product_id)""",
    "customer_performance": f"""
SELECT customer_id, age, gender, city, state, country, acquisition_source,
  CASE WHEN age < 25 THEN 'Under 25' WHEN age < 35 THEN '25-34' WHEN age < 45 THEN '35-44'
    WHEN age < 55 THEN '45-54' WHEN age < 65 THEN '55-64' ELSE '65+' END AS age_group,
  if(valid_orders = 1, 'One-time customer', 'Repeat customer') AS customer_type,
  valid_orders, total_items, returned_items, first_order_date, last_order_date, net_revenue, gross_profit,
  {ORDER_VALUE}, {RETURN_RATE}
FROM (
  SELECT customer_id, count(DISTINCT order_id) AS valid_orders, count(*) AS total_items,
    count(*) FILTER (came_back) AS returned_items, min(order_date) AS first_order_date,
    max(order_date) AS last_order_date, {NET}
  FROM valid_items GROUP BY ALL)
JOIN dim_customer USING (customer_id)""",
    "customer_yearly": f"""
SELECT order_year, customer_id,
  if(order_year = first_year, 'New customer', 'Repeat customer') AS customer_type,
  count(DISTINCT order_id) AS valid_orders, {NET}
FROM valid_items
JOIN (SELECT customer_id, min(order_year) AS first_year FROM valid_items GROUP BY ALL) USING (customer_id)
GROUP BY order_year, customer_id, first_year""",
    "session_funnel": """
SELECT session_id, traffic_source, browser, session_date, year(session_date)::INT AS session_year,
  month(session_date)::INT AS session_month, total_events, product_view_flag, cart_flag, purchase_flag,
  (product_view_flag > cart_flag)::INT AS product_to_cart_dropoff_flag,
  (cart_flag > purchase_flag)::INT AS cart_to_purchase_dropoff_flag
FROM session_flags""",
    "distribution_center_performance": f"""
SELECT d.distribution_center_id, distribution_center_name, latitude, longitude,
  coalesce(n, 0) AS orders_handled, coalesce(n_in, 0)::BIGINT AS delivered_orders,
  coalesce(n_back, 0)::BIGINT AS returned_orders, coalesce(n_off, 0)::BIGINT AS cancelled_orders,
  {mean6('ship_sum', 'ship_n')} AS average_days_to_ship,
  {mean6('in_sum', 'n_in')} AS average_days_to_deliver,
  {percent('n_in', 'n')} AS delivered_order_share_percent,
  {percent('n_back', 'n')} AS return_rate_percent,
  {percent('n_off', 'n')} AS cancellation_rate_percent,
  coalesce(rev, 0)::DECIMAL(38,2) AS net_revenue, coalesce(prof, 0)::DECIMAL(38,2) AS gross_profit,
  coalesce(n_stock, 0) AS total_inventory_items, coalesce(n_sold, 0) AS sold_items,
  coalesce(n_stock - n_sold, 0) AS unsold_items, {percent('n_sold', 'n_stock')} AS sell_through_rate_percent,
  coalesce(cost_left, 0)::DECIMAL(38,2) AS unsold_inventory_cost,
  coalesce(n_old, 0) AS unsold_items_180_plus_days, coalesce(cost_old, 0)::DECIMAL(38,2) AS old_inventory_cost,
  {mean2('sell_sum', 'sell_n')} AS average_days_to_sell,
  {mean2('age_sum', 'n_stock - n_sold')} AS average_unsold_age_days
FROM dim_distribution_center AS d
LEFT JOIN (
  SELECT distribution_center_id, count(*) AS n, sum(ship) AS ship_sum, count(ship) AS ship_n,
    sum(deliver) AS in_sum, count(deliver) AS n_in, count(*) FILTER (back) AS n_back,
    count(*) FILTER (off) AS n_off, sum(rev) AS rev, sum(prof) AS prof
  FROM (
    SELECT distribution_center_id, order_id, max(days_to_ship) AS ship, max(days_to_deliver) AS deliver,
      max(returned_flag) = 1 AS back, max(cancelled_flag) = 1 AS off,
      sum(if(item_status NOT IN ('Returned', 'Cancelled'), item_revenue, 0)) AS rev,
      sum(if(item_status NOT IN ('Returned', 'Cancelled'), gross_profit_before_returns, 0)) AS prof
    FROM period_items GROUP BY ALL)
  GROUP BY ALL) USING (distribution_center_id)
LEFT JOIN (
  SELECT distribution_center_id, count(*) AS n_stock, count(*) FILTER (sold) AS n_sold,
    sum(inventory_cost) FILTER (NOT sold) AS cost_left,
    count(*) FILTER (NOT sold AND age_days >= 180) AS n_old,
    sum(inventory_cost) FILTER (NOT sold AND age_days >= 180) AS cost_old,
    sum(age_days) FILTER (NOT sold) AS age_sum,
    sum(days_to_sell) FILTER (sold) AS sell_sum, count(days_to_sell) FILTER (sold) AS sell_n
  FROM stock GROUP BY ALL) USING (distribution_center_id)""",
    "order_fulfilment": """
SELECT order_id, count(DISTINCT distribution_center_id) AS distribution_center_count,
  max(days_to_ship) AS days_to_ship, max(days_to_deliver) AS days_to_deliver,
  max(returned_flag) AS returned_flag, max(cancelled_flag) AS cancelled_flag
FROM period_items GROUP BY ALL""",
}

# -- layers --------------------------------------------------------------------

LAYER_TABLES = {
    "src": {name: f"src_{name}" for name in SOURCES},
    "cleaned": {name: f"cleaned_{name}" for name in SOURCES},
    "analytics": {name: name for name in MODEL_KEYS},
    "reporting": {name: name for name in REPORTS},
}
TITLED = {name.capitalize(): f"src_{name}" for name in SOURCES}


def _content(name: str) -> str:
    gaps = " + ".join(f"({column} IS NULL)::BIGINT" for column, _ in COLUMNS[name])
    text = " + ".join(
        ["0", *(f"coalesce(length({c}), 0)" for c, kind in COLUMNS[name] if kind == "string")]
    )
    return (
        f"SELECT '{name}' AS table_name, count(*) AS row_count, sum({gaps})::BIGINT AS null_cells, "
        f"sum({text})::BIGINT AS text_length FROM src_{name}"
    )


def _key_report(label: str, table: str, key: str) -> str:
    return f"""SELECT '{label}' AS table_name, count(*) FILTER ({key} IS NULL) AS null_keys,
  count(DISTINCT {key}) FILTER (n > 1) AS duplicate_keys
FROM (SELECT {key}, count(*) OVER (PARTITION BY {key}) AS n FROM {table})"""


LAYER_STATEMENTS: dict[str, str] = {
    "load_csv": union(_content(name) for name in SOURCES),
    "create_layers": union(
        f"SELECT '{layer}' AS layer, count(*) AS relations, sum(row_count)::BIGINT AS row_count FROM ({counts(tables)})"
        for layer, tables in LAYER_TABLES.items()
    ),
    "row_counts_src": counts(TITLED),
    "schema_report": union(
        f"SELECT '{name}' AS table_name, {place} AS position, '{column}' AS column_name, "
        f"'{kind}' AS data_type, {column == KEYS[name]} AS is_key, count(*) - count({column}) AS null_rows FROM src_{name}"
        for name in SOURCES
        for place, (column, kind) in enumerate(COLUMNS[name], start=1)
    ),
    "pk_assert": _key_report("distribution_centers", "src_distribution_centers", "id"),
    "list_cleaned": counts(LAYER_TABLES["cleaned"]),
    "rebuild_model": counts(LAYER_TABLES["analytics"]),
    "materialise": union(
        f"SELECT '{name}' AS table_name, count(*) AS row_count, count(DISTINCT {key}) AS key_count FROM {name}"
        for name, key in MODEL_KEYS.items()
    ),
    "pk_assert_model": union(_key_report(name, name, key) for name, key in MODEL_KEYS.items()),
    "list_analytics": counts(LAYER_TABLES["analytics"]),
    "row_counts_model": counts(LAYER_TABLES["analytics"]),
    "session_cache": """
SELECT product_view_flag, cart_flag, purchase_flag, count(*) AS sessions FROM session_flags GROUP BY ALL""",
    "list_reporting": counts(LAYER_TABLES["reporting"]),
    "sales_monthly_preview": """
SELECT order_year, order_month, valid_orders, cancelled_orders, total_orders
FROM sales_monthly ORDER BY order_year, order_month LIMIT 60""",
    **{
        f"preview_{name}": f"SELECT * FROM src_{name} ORDER BY {KEYS[name]} NULLS FIRST LIMIT 20"
        for name in SOURCES
    },
}

# -- profiling -----------------------------------------------------------------


def _missing(table: str, **columns: str) -> str:
    gaps = ", ".join(f"count(*) FILTER ({c} IS NULL) AS missing_{label}" for label, c in columns.items())
    return f"SELECT count(*) AS total_rows, {gaps} FROM src_{table}"


def _frequency(table: str, column: str, count: str) -> str:
    return f"SELECT rtrim({column}) AS {column}, count(*) AS {count} FROM src_{table} GROUP BY ALL"


def _range(table: str, columns: dict[str, str], scale: int = 1) -> str:
    """Bounds and average; ``scale`` makes amounts whole."""
    parts = []
    for label, column in columns.items():
        whole = f"sum({column} * {scale})"
        parts.append(
            f"min({column}) AS minimum_{label}, max({column}) AS maximum_{label}, "
            f"{mean2(whole, f'{scale} * count({column})')} AS average_{label}"
        )
    return f"SELECT {', '.join(parts)} FROM src_{table}"


PROFILING_STATEMENTS: dict[str, str] = {
    "dup_keys": union(
        f"SELECT '{name.capitalize()}' AS table_name, count(*) AS duplicate_keys "
        f"FROM (SELECT 1 FROM src_{name} GROUP BY {KEYS[name]} HAVING count(*) > 1)"
        for name in SOURCES
    ),
    "missing_users": _missing(
        "users", id="id", created_at="created_at", country="country", traffic_source="traffic_source"
    ),
    "missing_products": _missing(
        "products",
        id="id",
        category="category",
        cost="cost",
        retail_price="retail_price",
        distribution_center_id="distribution_center_id",
    ),
    "missing_orders": _missing(
        "orders",
        order_id="order_id",
        user_id="user_id",
        status="status",
        created_at="created_at",
        item_count="num_of_item",
    ),
    "missing_order_items": _missing(
        "order_items",
        **{
            c: c
            for c in (
                "id",
                "order_id",
                "user_id",
                "product_id",
                "inventory_item_id",
                "status",
                "created_at",
                "sale_price",
            )
        },
    ),
    "missing_inventory": _missing(
        "inventory_items",
        id="id",
        product_id="product_id",
        created_at="created_at",
        cost="cost",
        category="product_category",
        retail_price="product_retail_price",
        distribution_center_id="product_distribution_center_id",
    ),
    "missing_events": _missing(
        "events",
        **{
            c: c
            for c in ("id", "session_id", "sequence_number", "created_at", "event_type", "traffic_source")
        },
    ),
    "date_coverage": union(
        f"SELECT '{t}' AS table_name, min(created_at) AS earliest_date, max(created_at) AS latest_date FROM src_{t}"
        for t in ("users", "orders", "inventory_items", "events")
    ),
    "freq_order_status": _frequency("orders", "status", "order_count"),
    "freq_event_type": _frequency("events", "event_type", "event_count"),
    "freq_country": _frequency("users", "country", "customer_count"),
    "freq_traffic_source": _frequency("users", "traffic_source", "customer_count"),
    "freq_category": _frequency("products", "category", "product_count"),
    "range_age": _range("users", {"age": "age"}),
    "range_product_price": _range(
        "products", {c: f"{c}::DECIMAL(12,2)" for c in ("cost", "retail_price")}, 100
    ),
    "range_sale_price": _range("order_items", {"sale_price": "sale_price::DECIMAL(12,2)"}, 100),
    "range_item_count": _range("orders", {"items": "num_of_item"}),
}

# -- relationships ---------------------------------------------------------------


def _orphans(issue: str, child: str, reference: str, parent: str, key: str) -> str:
    return f"""SELECT '{issue}' AS potential_issue, count(*) AS affected_rows FROM src_{child} AS c
WHERE NOT EXISTS (SELECT 1 FROM src_{parent} AS p WHERE p.{key} = c.{reference})"""


RELATION_STATEMENTS: dict[str, str] = {
    "orphan_census": union(
        (
            _orphans("Orders without users", "orders", "user_id", "users", "id"),
            _orphans("Order items without orders", "order_items", "order_id", "orders", "order_id"),
            _orphans("Order items without users", "order_items", "user_id", "users", "id"),
            _orphans("Order items without products", "order_items", "product_id", "products", "id"),
            _orphans(
                "Order items without inventory items",
                "order_items",
                "inventory_item_id",
                "inventory_items",
                "id",
            ),
            _orphans(
                "Products without distribution centers",
                "products",
                "distribution_center_id",
                "distribution_centers",
                "id",
            ),
            _orphans("Inventory items without products", "inventory_items", "product_id", "products", "id"),
        )
    ),
    "mismatch_customer": """
SELECT count(*) AS mismatched_customer_rows
FROM src_order_items AS i, src_orders AS o WHERE o.order_id = i.order_id AND o.user_id <> i.user_id""",
    "mismatch_status": """
SELECT count(*) AS mismatched_status_rows
FROM src_order_items AS i, src_orders AS o
WHERE o.order_id = i.order_id AND rtrim(o.status) <> rtrim(i.status)""",
    "mismatch_item_count": """
SELECT count(*) AS orders_with_wrong_item_count
FROM src_orders AS o, (SELECT order_id, count(*) AS n FROM src_order_items GROUP BY ALL) AS a
WHERE a.order_id = o.order_id AND a.n <> o.num_of_item""",
    "mismatch_product": """
SELECT count(*) AS mismatched_inventory_products
FROM src_order_items AS i, src_inventory_items AS s
WHERE s.id = i.inventory_item_id AND s.product_id <> i.product_id""",
    "mismatch_center": """
SELECT count(*) AS mismatched_distribution_centers
FROM src_inventory_items AS s, src_products AS p
WHERE p.id = s.product_id AND p.distribution_center_id <> s.product_distribution_center_id""",
}

# -- quality -----------------------------------------------------------------------


def _empty(*columns: str) -> str:
    return " OR ".join(f"coalesce(trim({c}), '') = ''" for c in columns)


STATUS_DATES = """CASE rtrim(status)
  WHEN 'Shipped' THEN shipped_at IS NULL
  WHEN 'Complete' THEN shipped_at IS NULL OR delivered_at IS NULL
  WHEN 'Returned' THEN shipped_at IS NULL OR delivered_at IS NULL OR returned_at IS NULL
  WHEN 'Processing' THEN coalesce(shipped_at, delivered_at, returned_at) IS NOT NULL
  WHEN 'Cancelled' THEN coalesce(shipped_at, delivered_at, returned_at) IS NOT NULL
  ELSE false END"""

# Check -> relation, output column, condition.
QUALITY_RULES = {
    "blank_users": ("users", "users_with_blank_dimensions", _empty("country", "traffic_source")),
    "blank_products": ("products", "products_with_blank_dimensions", _empty("category", "brand", "department")),
    "blank_orders": ("orders", "orders_with_blank_status", _empty("status")),
    "blank_events": (
        "events",
        "events_with_blank_dimensions",
        _empty("session_id", "event_type", "traffic_source", "browser"),
    ),
    "invalid_ages": ("users", "invalid_ages", "age NOT BETWEEN 0 AND 120"),
    "invalid_product_prices": (
        "products",
        "products_with_invalid_prices",
        "cost < 0 OR retail_price <= 0 OR retail_price < cost",
    ),
    "invalid_sale_prices": ("order_items", "invalid_sale_prices", "sale_price <= 0"),
    "invalid_item_counts": ("orders", "invalid_item_counts", "num_of_item <= 0"),
    "invalid_inventory_prices": (
        "inventory_items",
        "inventory_with_invalid_prices",
        "cost < 0 OR product_retail_price <= 0 OR product_retail_price < cost",
    ),
    "invalid_event_sequences": ("events", "invalid_event_sequences", "sequence_number <= 0"),
    "orders_bad_dates": ("orders", "orders_with_invalid_date_sequence", BAD_DATES),
    "items_bad_dates": ("order_items", "order_items_with_invalid_date_sequence", BAD_DATES),
    "items_shipped_before_created": ("order_items", "shipped_before_created", "created_at > shipped_at"),
    "items_delivered_before_shipped": ("order_items", "delivered_before_shipped", "shipped_at > delivered_at"),
    "items_returned_before_delivered": ("order_items", "returned_before_delivered", "delivered_at > returned_at"),
    "sold_before_created": ("inventory_items", "inventory_sold_before_creation", "created_at > sold_at"),
    "orders_status_dates": ("orders", "orders_with_status_date_issues", STATUS_DATES),
    "items_status_dates": ("order_items", "order_items_with_status_date_issues", STATUS_DATES),
}

QUALITY_STATEMENTS: dict[str, str] = {
    **{
        check: f"SELECT count(*) AS {alias} FROM src_{table} WHERE {condition}"
        for check, (table, alias, condition) in QUALITY_RULES.items()
    },
    "quality_scorecard": union(
        f"SELECT '{table}' AS table_name, '{check}' AS check_name, count(*) AS affected_rows "
        f"FROM src_{table} WHERE {condition}"
        for check, (table, _, condition) in QUALITY_RULES.items()
    ),
    "blank_products_by_column": "SELECT count(*) AS total_products, "
    + ", ".join(
        f"count(*) FILTER ({_empty(c)}) AS missing_{c}" for c in ("category", "brand", "department", "name")
    )
    + " FROM src_products",
    "worst_ship_gaps": """
SELECT id, order_id, created_at, shipped_at, date_diff('hour', created_at, shipped_at)::INT AS hours_to_ship
FROM src_order_items WHERE shipped_at < created_at ORDER BY hours_to_ship, id LIMIT 20""",
    "dup_session_sequence": """
SELECT count(*) AS duplicate_session_sequences
FROM (SELECT 1 FROM src_events GROUP BY rtrim(session_id), sequence_number HAVING count(*) > 1)""",
    "session_gaps": """
SELECT count(*) AS sessions_with_sequence_gaps
FROM (SELECT 1 FROM src_events WHERE session_id IS NOT NULL AND sequence_number IS NOT NULL
      GROUP BY rtrim(session_id) HAVING min(sequence_number) <> 1 OR max(sequence_number) <> count(*))""",
    "country_variants": """
SELECT rtrim(country) AS country, count(*) AS user_count FROM src_users
WHERE rtrim(country) IN ('Germany', 'Deutschland', 'Spain', 'España', 'Brazil', 'Brasil') GROUP BY ALL""",
    "session_multi_attr": """
SELECT count(*) AS sessions_with_multiple_attributes
FROM (SELECT 1 FROM src_events WHERE session_id IS NOT NULL GROUP BY rtrim(session_id)
      HAVING count(DISTINCT rtrim(traffic_source)) > 1 OR count(DISTINCT rtrim(browser)) > 1)""",
}

CLEANED_STATEMENTS: dict[str, str] = {
    "clean_users": "SELECT * FROM cleaned_users",
    "clean_products": "SELECT * FROM cleaned_products",
    "clean_orders": "SELECT * FROM cleaned_orders",
    "clean_order_items": "SELECT * FROM cleaned_order_items",
    "clean_inventory": "SELECT * FROM cleaned_inventory_items",
    "clean_centers": "SELECT * FROM cleaned_distribution_centers",
    "clean_events": "SELECT * FROM cleaned_events",
    "country_post_check": """
SELECT country, count(*) AS user_count FROM cleaned_users
WHERE country IN ('Germany', 'Deutschland', 'Spain', 'España', 'Brazil', 'Brasil') GROUP BY ALL""",
}

MODEL_STATEMENTS: dict[str, str] = {
    **{name: f"SELECT * FROM {name}" for name in MODEL_KEYS},
    "flagged_revenue_share": f"""
SELECT invalid_date_sequence_flag, total_items, item_revenue,
  {money_percent('item_revenue', 'grand_total')} AS revenue_share_percent
FROM (
  SELECT invalid_date_sequence_flag, count(*) AS total_items, sum(item_revenue)::DECIMAL(38,2) AS item_revenue,
    (SELECT sum(item_revenue) FROM period_items) AS grand_total
  FROM period_items GROUP BY ALL)""",
}

# -- sales ---------------------------------------------------------------------------


def _sales_by(group: str, extra: str = "", source: str = "valid_items") -> str:
    head = f"{group}, " if group else ""
    return f"SELECT {head}{extra}{NET} FROM {source} GROUP BY ALL"


ORDERS = "count(DISTINCT order_id) AS valid_orders, "
BUYERS = "count(DISTINCT customer_id) AS total_customers, "

SALES_STATEMENTS: dict[str, str] = {
    "item_statuses": "SELECT item_status, count(*) AS item_count FROM fact_order_items GROUP BY ALL",
    "overall_kpis": f"SELECT *, {MARGIN} FROM ({_sales_by('', ORDERS + BUYERS)})",
    "annual_performance": _sales_by("order_year", ORDERS + BUYERS),
    "monthly_trend": f"""
SELECT order_year, order_month, valid_orders, net_revenue, previous_month_revenue,
  {money_growth('net_revenue', 'previous_month_revenue')} AS monthly_revenue_growth_percent,
  gross_profit, previous_month_profit,
  {money_growth('gross_profit', 'previous_month_profit')} AS monthly_profit_growth_percent,
  cumulative_revenue, cumulative_profit
FROM (
  SELECT m.*, p.net_revenue AS previous_month_revenue, p.gross_profit AS previous_month_profit,
    (SELECT sum(e.net_revenue)::DECIMAL(38,2) FROM months AS e WHERE e.place <= m.place) AS cumulative_revenue,
    (SELECT sum(e.gross_profit)::DECIMAL(38,2) FROM months AS e WHERE e.place <= m.place) AS cumulative_profit
  FROM months AS m LEFT JOIN months AS p ON p.place = m.place - 1)""",
    "yoy_growth": f"""
SELECT y.order_year, y.net_revenue, y.gross_profit,
  {money_growth('y.net_revenue', 'p.net_revenue')} AS revenue_growth_percent,
  {money_growth('y.gross_profit', 'p.gross_profit')} AS profit_growth_percent
FROM years AS y LEFT JOIN years AS p ON p.place = y.place - 1""",
    "aov_by_year": f"""
SELECT order_year, net_revenue, valid_orders, {ORDER_VALUE} FROM ({_sales_by('order_year', ORDERS)})""",
}

PERIODS = {
    "months": f"""
SELECT *, row_number() OVER (ORDER BY order_year, order_month) AS place
FROM ({_sales_by('order_year, order_month', ORDERS)})""",
    "years": f"SELECT *, row_number() OVER (ORDER BY order_year) AS place FROM ({_sales_by('order_year')})",
    "sold_products": f"""
SELECT p.product_id, p.product_name, p.category, p.brand, s.total_items, s.returned_items, s.net_revenue,
  s.gross_profit
FROM dim_product AS p JOIN (
  SELECT product_id, count(*) AS total_items, count(*) FILTER (came_back) AS returned_items, {NET}
  FROM valid_items GROUP BY ALL) AS s USING (product_id)""",
}


def _products_by(attribute: str) -> str:
    return f"""
SELECT *, {MARGIN}, {RETURN_RATE}
FROM (SELECT {attribute}, sum(total_items)::BIGINT AS total_items, sum(returned_items)::BIGINT AS returned_items,
        sum(net_revenue)::DECIMAL(38,2) AS net_revenue, sum(gross_profit)::DECIMAL(38,2) AS gross_profit
      FROM sold_products GROUP BY ALL)"""


PRODUCT_STATEMENTS: dict[str, str] = {
    "category_performance": _products_by("category"),
    "brand_performance": _products_by("brand"),
    "top_products": f"""
SELECT * EXCLUDE (returned_items), {MARGIN}, {RETURN_RATE}
FROM sold_products ORDER BY net_revenue DESC, product_id LIMIT 10""",
    "product_rank_in_category": f"""
SELECT product_id, product_name, category, total_items, net_revenue, gross_profit,
  dense_rank() OVER (PARTITION BY category ORDER BY net_revenue DESC) AS revenue_rank_in_category,
  dense_rank() OVER (PARTITION BY category ORDER BY gross_profit DESC) AS profit_rank_in_category,
  {money_percent('net_revenue', 'category_revenue', 4)} AS category_revenue_share_percent
FROM (SELECT *, sum(net_revenue) OVER (PARTITION BY category) AS category_revenue FROM sold_products)""",
    "high_revenue_low_margin": f"""
SELECT * FROM (
  SELECT product_id, product_name, category, brand, net_revenue, gross_profit, {MARGIN}
  FROM sold_products ORDER BY net_revenue DESC, product_id LIMIT 50)
ORDER BY gross_margin_percent ASC NULLS FIRST, net_revenue DESC, product_id LIMIT 10""",
    "highest_return_rates": f"""
SELECT product_id, product_name, category, brand, total_items, returned_items, {RETURN_RATE}
FROM sold_products WHERE total_items >= 10
ORDER BY return_rate_percent DESC NULLS LAST, total_items DESC, product_id LIMIT 10""",
    "lost_value": """
SELECT item_status, count(*) AS affected_items, sum(item_revenue)::DECIMAL(38,2) AS potential_revenue_lost,
  sum(gross_profit_before_returns)::DECIMAL(38,2) AS potential_gross_profit_lost
FROM period_items WHERE came_back OR called_off GROUP BY ALL""",
    "items_per_product_histogram": """
SELECT total_items, count(*) AS number_of_products
FROM (SELECT count(*) AS total_items FROM valid_items GROUP BY product_id) GROUP BY ALL""",
}

# -- customers -------------------------------------------------------------------------


def _customers_by(group: str, name: str, valued: bool) -> str:
    rates = f", {money_ratio('net_revenue', 'total_customers')} AS revenue_per_customer, {ORDER_VALUE}"
    return f"""
SELECT *{rates if valued else ''}
FROM (SELECT {group} AS {name}, {BUYERS}{ORDERS}{NET}
      FROM valid_items JOIN dim_customer USING (customer_id) GROUP BY ALL)"""


AGE_BAND = """CASE WHEN age < 25 THEN 'Under 25' WHEN age < 35 THEN '25-34' WHEN age < 45 THEN '35-44'
  WHEN age < 55 THEN '45-54' WHEN age < 65 THEN '55-64' ELSE '65+' END"""

CUSTOMER_STATEMENTS: dict[str, str] = {
    "one_time_vs_repeat": f"""
SELECT *, {quotient('valid_orders', 'total_customers')} AS average_orders_per_customer,
  {money_ratio('net_revenue', 'total_customers')} AS revenue_per_customer
FROM (
  SELECT if(n = 1, 'One-time customer', 'Repeat customer') AS customer_type, count(*) AS total_customers,
    sum(n)::BIGINT AS valid_orders, sum(r)::DECIMAL(38,2) AS net_revenue, sum(g)::DECIMAL(38,2) AS gross_profit
  FROM (SELECT customer_id, count(DISTINCT order_id) AS n, sum(kept_revenue) AS r, sum(kept_profit) AS g
        FROM valid_items GROUP BY ALL)
  GROUP BY ALL)""",
    "new_vs_repeat_by_year": """
SELECT order_year, customer_type, count(*) AS total_customers, sum(valid_orders)::BIGINT AS valid_orders,
  sum(net_revenue)::DECIMAL(38,2) AS net_revenue, sum(gross_profit)::DECIMAL(38,2) AS gross_profit
FROM customer_yearly GROUP BY ALL""",
    "order_frequency": """
SELECT valid_orders, count(*) AS number_of_customers
FROM (SELECT count(DISTINCT order_id) AS valid_orders FROM valid_items GROUP BY customer_id) GROUP BY ALL""",
    "by_country": _customers_by("country", "country", True),
    "by_acquisition_source": _customers_by("acquisition_source", "acquisition_source", True),
    "by_age_group": _customers_by(AGE_BAND, "age_group", False),
    "by_gender": _customers_by("gender", "gender", False),
    "purchase_sequence": """
SELECT customer_id, order_id, order_date,
  row_number() OVER (PARTITION BY customer_id ORDER BY order_date, order_id) AS customer_order_number,
  lag(order_date) OVER (PARTITION BY customer_id ORDER BY order_date, order_id) AS previous_order_date,
  (order_date - previous_order_date)::INT AS days_since_previous_order, order_revenue
FROM (SELECT customer_id, order_id, min(order_date) AS order_date,
        sum(kept_revenue)::DECIMAL(38,2) AS order_revenue
      FROM valid_items GROUP BY customer_id, order_id)""",
}

# -- funnel ----------------------------------------------------------------------------

REACH = """count(*) AS total_sessions, sum(product_view_flag)::BIGINT AS product_view_sessions,
  sum(cart_flag)::BIGINT AS cart_sessions, sum(purchase_flag)::BIGINT AS purchase_sessions"""
CONVERSION = f"{percent('purchase_sessions', 'total_sessions')} AS session_conversion_rate"
STEP_RATES = f"""{percent('cart_sessions', 'product_view_sessions')} AS product_to_cart_rate,
  {percent('purchase_sessions', 'cart_sessions')} AS cart_to_purchase_rate, {CONVERSION}"""

FUNNEL_STATEMENTS: dict[str, str] = {
    "event_types": f"""
SELECT event_type, count(*) AS total_events FROM fact_events WHERE event_date < {EVENT_CUTOFF} GROUP BY ALL""",
    "session_flags": "SELECT * EXCLUDE (total_events) FROM session_flags",
    "cart_without_product": """
SELECT count(*) AS cart_without_product FROM session_flags WHERE cart_flag > product_view_flag""",
    "purchase_without_cart": """
SELECT count(*) AS purchase_without_cart FROM session_flags WHERE purchase_flag > cart_flag""",
    "funnel_overall": f"""
SELECT *, product_view_sessions - cart_sessions AS product_to_cart_dropoff,
  cart_sessions - purchase_sessions AS cart_to_purchase_dropoff, {STEP_RATES}
FROM (SELECT {REACH} FROM session_flags)""",
    "funnel_by_source": f"""
SELECT *, {STEP_RATES} FROM (SELECT traffic_source, {REACH} FROM session_flags GROUP BY ALL)""",
    "funnel_by_browser": f"""
SELECT *, {STEP_RATES} FROM (SELECT browser, {REACH} FROM session_flags GROUP BY ALL)""",
    "funnel_monthly": f"""
SELECT *, {CONVERSION}
FROM (SELECT year(session_date)::INT AS session_year, month(session_date)::INT AS session_month, {REACH}
      FROM session_flags GROUP BY ALL)""",
}

# -- logistics ---------------------------------------------------------------------------

LEAD_TIMES = f"""{mean6('ship_sum', 'ship_n')} AS average_days_to_ship,
  {mean6('in_sum', 'in_n')} AS average_days_to_deliver"""
OUTCOMES = f"""{percent('delivered_orders', 'total_orders')} AS delivery_rate_percent,
  {percent('returned_orders', 'total_orders')} AS return_rate_percent,
  {percent('cancelled_orders', 'total_orders')} AS cancellation_rate_percent"""
ORDER_SUMS = """count(*) AS total_orders, sum(shipped_flag)::BIGINT AS shipped_orders,
  sum(delivered_flag)::BIGINT AS delivered_orders, sum(returned_flag)::BIGINT AS returned_orders,
  sum(cancelled_flag)::BIGINT AS cancelled_orders, sum(days_to_ship) AS ship_sum, count(days_to_ship) AS ship_n,
  sum(days_to_deliver) AS in_sum, count(days_to_deliver) AS in_n"""
STOCK_SUMS = """count(*) AS total_inventory_items, count(*) FILTER (sold) AS sold_items,
  count(*) FILTER (NOT sold) AS unsold_items,
  coalesce(sum(inventory_cost) FILTER (NOT sold), 0)::DECIMAL(38,2) AS unsold_inventory_cost,
  coalesce(sum(product_retail_price) FILTER (NOT sold), 0)::DECIMAL(38,2) AS unsold_retail_value"""
SELL_THROUGH = f"{percent('sold_items', 'total_inventory_items')} AS sell_through_rate_percent"

LOGISTICS_STATEMENTS: dict[str, str] = {
    "logistics_overall": f"""
SELECT total_orders, shipped_orders, delivered_orders, returned_orders, cancelled_orders, {LEAD_TIMES}, {OUTCOMES}
FROM (SELECT {ORDER_SUMS} FROM fact_orders WHERE order_date < {SALES_CUTOFF})""",
    "logistics_by_year": f"""
SELECT order_year, total_orders, {LEAD_TIMES}, {OUTCOMES}
FROM (SELECT year(order_date)::INT AS order_year, {ORDER_SUMS}
      FROM fact_orders WHERE order_date < {SALES_CUTOFF} GROUP BY ALL)""",
    "logistics_by_center": f"""
SELECT distribution_center_name, orders_handled, {LEAD_TIMES},
  {percent('back', 'orders_handled')} AS return_rate_percent,
  {percent('off', 'orders_handled')} AS cancellation_rate_percent
FROM (
  SELECT distribution_center_name, count(*) AS orders_handled, sum(ship) AS ship_sum, count(ship) AS ship_n,
    sum(deliver) AS in_sum, count(deliver) AS in_n, sum(b) AS back, sum(c) AS off
  FROM (SELECT distribution_center_id, order_id, max(days_to_ship) AS ship, max(days_to_deliver) AS deliver,
          max(returned_flag) AS b, max(cancelled_flag) AS c
        FROM period_items GROUP BY ALL)
  JOIN dim_distribution_center USING (distribution_center_id) GROUP BY ALL)""",
    "inventory_overall": f"SELECT *, {SELL_THROUGH} FROM (SELECT {STOCK_SUMS} FROM stock)",
    "inventory_by_center": f"""
SELECT *, {SELL_THROUGH}
FROM (SELECT distribution_center_name, {STOCK_SUMS}
      FROM stock JOIN dim_distribution_center USING (distribution_center_id) GROUP BY ALL)""",
    "inventory_aging": """
SELECT CASE WHEN age_days < 30 THEN 'Under 30 days' WHEN age_days < 90 THEN '30-89 days'
    WHEN age_days < 180 THEN '90-179 days' ELSE '180+ days' END AS age_group,
  count(*) AS unsold_items, sum(inventory_cost)::DECIMAL(38,2) AS unsold_inventory_cost
FROM stock WHERE NOT sold GROUP BY ALL""",
    "slow_movers": f"""
SELECT product_id, product_name, category, brand, unsold_items, unsold_inventory_cost,
  {mean6('age_sum', 'unsold_items')} AS average_inventory_age_days
FROM (SELECT product_id, count(*) AS unsold_items, sum(inventory_cost)::DECIMAL(38,2) AS unsold_inventory_cost,
        sum(age_days) AS age_sum
      FROM stock WHERE NOT sold AND age_days >= 180 GROUP BY ALL)
JOIN dim_product USING (product_id) ORDER BY unsold_inventory_cost DESC, product_id LIMIT 10""",
    "inventory_by_year": """
SELECT year(inventory_created_date)::INT AS inventory_year, count(*) AS total_items,
  count(*) FILTER (sold) AS sold_items, count(*) FILTER (NOT sold) AS unsold_items
FROM stock GROUP BY ALL""",
}

# -- headline figures ----------------------------------------------------------------------

HEADLINE_STATEMENTS: dict[str, str] = {
    "headline_sales": f"""
SELECT y.order_year, y.valid_orders, y.net_revenue, y.gross_profit, y.gross_margin_percent,
  y.average_order_value, t.total_revenue,
  {money_growth('y.net_revenue', 'p.net_revenue')} AS revenue_growth_percent,
  {money_growth('y.average_order_value', 'p.average_order_value')} AS order_value_change_percent,
  {money_percent('t.total_profit', 't.total_revenue')} AS total_margin_percent
FROM report_years AS y LEFT JOIN report_years AS p ON p.place = y.place - 1,
  (SELECT sum(net_revenue)::DECIMAL(38,2) AS total_revenue, sum(gross_profit) AS total_profit FROM report_years) AS t""",
    "cart_abandonment": f"""
SELECT *, {percent('cart_sessions', 'total_sessions')} AS session_to_cart_rate, {CONVERSION}
FROM (SELECT session_year, count(*) AS total_sessions, sum(cart_flag)::BIGINT AS cart_sessions,
        sum(purchase_flag)::BIGINT AS purchase_sessions,
        sum(cart_to_purchase_dropoff_flag)::BIGINT AS abandoned_sessions
      FROM session_funnel GROUP BY GROUPING SETS ((session_year), ()))""",
    "returning_share": f"""
SELECT *, {percent('returning_customers', 'total_customers')} AS returning_share_percent
FROM (SELECT count(DISTINCT customer_id) AS total_customers,
        count(DISTINCT customer_id) FILTER (customer_type = 'Repeat customer') AS returning_customers
      FROM customer_yearly)""",
    "source_concentration": f"""
SELECT acquisition_source AS top_source, r AS top_source_revenue,
  (everything - r)::DECIMAL(38,2) AS other_sources_revenue,
  {money_percent('r', 'everything')} AS top_source_share_percent
FROM (SELECT acquisition_source, sum(net_revenue)::DECIMAL(38,2) AS r,
        (SELECT sum(net_revenue) FROM customer_performance) AS everything
      FROM customer_performance GROUP BY ALL)
ORDER BY r DESC, acquisition_source DESC NULLS LAST LIMIT 1""",
    "customers_per_age": "SELECT age, count(*) AS total_customers FROM customer_performance GROUP BY ALL",
    "category_vs_average_margin": f"""
SELECT c.*, average_category_margin_percent,
  (gross_margin_percent - average_category_margin_percent)::DECIMAL(38,2) AS above_average_points
FROM category_margins AS c,
  (SELECT {mean2('sum(gross_margin_percent * 100)', '100 * count(gross_margin_percent)')}
     AS average_category_margin_percent FROM category_margins)""",
    "unsold_capital": f"""
SELECT *, {SELL_THROUGH}
FROM (SELECT sum(total_inventory_items)::BIGINT AS total_inventory_items, sum(sold_items)::BIGINT AS sold_items,
        sum(unsold_items)::BIGINT AS unsold_items, sum(unsold_inventory_cost)::DECIMAL(38,2) AS unsold_inventory_cost,
        sum(old_inventory_cost)::DECIMAL(38,2) AS old_inventory_cost
      FROM distribution_center_performance)""",
    "order_count_trio": f"""
SELECT total_orders, valid_orders, center_assignments, cancelled_orders,
  {percent('cancelled_orders', 'total_orders')} AS cancelled_of_total_percent,
  {percent('cancelled_orders', 'valid_orders')} AS cancelled_of_valid_percent,
  {percent('single', 'fulfilled')} AS single_center_share_percent
FROM
  (SELECT sum(total_orders)::BIGINT AS total_orders, sum(valid_orders)::BIGINT AS valid_orders,
     sum(cancelled_orders)::BIGINT AS cancelled_orders FROM sales_monthly),
  (SELECT sum(orders_handled)::BIGINT AS center_assignments FROM distribution_center_performance),
  (SELECT count(*) AS fulfilled, count(*) FILTER (distribution_center_count = 1) AS single FROM order_fulfilment)""",
}

REPORT_CUTS = {
    "report_years": f"""
SELECT *, {MARGIN}, {ORDER_VALUE}, row_number() OVER (ORDER BY order_year) AS place
FROM (SELECT order_year, sum(valid_orders)::BIGINT AS valid_orders, sum(net_revenue)::DECIMAL(38,2) AS net_revenue,
        sum(gross_profit)::DECIMAL(38,2) AS gross_profit FROM sales_monthly GROUP BY ALL)""",
    "category_margins": f"""
SELECT *, {MARGIN}
FROM (SELECT category, sum(net_revenue)::DECIMAL(38,2) AS net_revenue,
        sum(gross_profit)::DECIMAL(38,2) AS gross_profit FROM product_performance GROUP BY ALL)""",
}

BODIES: dict[str, str] = {
    **LAYER_STATEMENTS,
    **PROFILING_STATEMENTS,
    **RELATION_STATEMENTS,
    **QUALITY_STATEMENTS,
    **CLEANED_STATEMENTS,
    **MODEL_STATEMENTS,
    **SALES_STATEMENTS,
    **PRODUCT_STATEMENTS,
    **CUSTOMER_STATEMENTS,
    **FUNNEL_STATEMENTS,
    **LOGISTICS_STATEMENTS,
    **{name: f"SELECT * FROM {name}" for name in REPORTS},
    **HEADLINE_STATEMENTS,
}

ORACLE_SQL: dict[str, str] = {
    name: with_relations(body, {**PERIODS, **REPORTS, **REPORT_CUTS}) for name, body in BODIES.items()
}
