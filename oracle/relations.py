"""The layers as SQL common table expressions over the test tables."""

from __future__ import annotations

import re

SALES_CUTOFF = "DATE '2001-08-01'"
EVENT_CUTOFF = "DATE '2024-01-30'"


def trimmed(*names: str) -> str:
    """A REPLACE list that trims text columns and turns blanks into NULL."""
    return ", ".join(f"nullif(trim({n}), '') AS {n}" for n in names)


BAD_DATES = "(shipped_at < created_at OR delivered_at < shipped_at OR returned_at < delivered_at)"

RELATIONS: dict[str, str] = {
    # -- raw ------------------------------------------------------------------
    "src_users": """
SELECT c_custkey AS id, ' ' || c_name || ' ' AS first_name, NULL::VARCHAR AS last_name,
  'c' || c_custkey::VARCHAR || '@x.test' AS email,
  (CASE WHEN c_custkey % 301 = 0 THEN NULL WHEN c_custkey % 302 = 0 THEN -1
        ELSE 12 + c_custkey % 59 END)::INT AS age,
  if(c_custkey % 2 = 0, 'F', 'M') AS gender, n_name AS state, '  ' AS street_address,
  NULL::VARCHAR AS postal_code, n_name AS city,
  CASE n_nationkey % 8 WHEN 0 THEN 'Germany' WHEN 1 THEN 'Deutschland' WHEN 2 THEN ' España'
    WHEN 3 THEN 'Spain ' WHEN 4 THEN 'Brasil' WHEN 5 THEN 'Brazil' WHEN 6 THEN '  '
    ELSE n_name END AS country,
  n_nationkey::DOUBLE AS latitude, c_acctbal AS longitude, c_mktsegment AS traffic_source,
  (DATE '1993-01-01' + (c_custkey % 700)::INT)::TIMESTAMP AS created_at
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""",
    "src_products": """
SELECT p_partkey AS id,
  (CASE WHEN p_partkey % 101 = 0 THEN p_retailprice::DECIMAL(12,2) + 1
        ELSE p_retailprice::DECIMAL(12,2) * (30 + p_partkey % 40)::DECIMAL(4,0) * 0.01
   END)::DECIMAL(12,2)::DOUBLE AS cost,
  p_type AS category, p_name AS name,
  CASE p_partkey % 83 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE p_brand || ' ' END AS brand,
  p_retailprice::DECIMAL(12,2)::DOUBLE AS retail_price,
  if(p_size <= 25, 'Men', 'Women') AS department, 'SKU-' || p_partkey::VARCHAR AS sku,
  p_partkey % 10 AS distribution_center_id
FROM part""",
    "src_orders": """
SELECT order_id, user_id, status, gender, created_at,
  if(status = 'Returned', day + (step + 2 + lag5 + order_id % 3)::INT, NULL)::TIMESTAMP AS returned_at,
  if(status IN ('Shipped', 'Complete', 'Returned'), day + step::INT, NULL)::TIMESTAMP AS shipped_at,
  if(status IN ('Complete', 'Returned'), day + (step + 1 + lag5)::INT, NULL)::TIMESTAMP AS delivered_at,
  (order_id % 7)::INT AS num_of_item
FROM (
  SELECT o_orderkey AS order_id, o_custkey AS user_id, if(o_custkey % 2 = 0, 'F', 'M') AS gender,
    o_orderdate AS created_at, o_orderdate::DATE AS day, o_orderkey % 4 AS step, o_orderkey % 5 AS lag5,
    CASE WHEN o_orderkey % 499 = 0 THEN '  ' WHEN o_orderstatus = 'O' THEN 'Shipped'
      WHEN o_orderstatus = 'F' THEN if(o_orderkey % 3 = 0, 'Returned', 'Complete')
      WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN 'Cancelled'
      ELSE 'Processing' END AS status
  FROM orders)""",
    "placed_lines": """
SELECT *, row_number() OVER (ORDER BY l_orderkey NULLS FIRST, l_linenumber, l_partkey, l_suppkey, l_shipdate,
    l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS line_key
FROM lineitem""",
    "lines": """
SELECT l.*, o.user_id, o.status AS order_status, o.created_at, o.shipped_at, o.delivered_at, o.returned_at
FROM placed_lines AS l LEFT JOIN src_orders AS o ON o.order_id = l.l_orderkey""",
    "src_order_items": """
SELECT line_key AS id, l_orderkey AS order_id, user_id, l_partkey AS product_id, line_key AS inventory_item_id,
  if(l_returnflag = 'R' AND order_status = 'Complete', 'Returned', order_status) AS status, created_at,
  if(shipped_at IS NULL, NULL, l_shipdate) AS shipped_at,
  if(l_linestatus = 'F', delivered_at, NULL) AS delivered_at, returned_at,
  l_extendedprice::DECIMAL(12,2)::DOUBLE AS sale_price
FROM lines""",
    "src_inventory_items": """
SELECT s.id, s.product_id, s.created_at::TIMESTAMP AS created_at, s.sold_at::TIMESTAMP AS sold_at,
  s.cost::DECIMAL(12,2)::DOUBLE AS cost, p.category AS product_category, p.name AS product_name,
  p.brand AS product_brand, s.price::DOUBLE AS product_retail_price, p.department AS product_department,
  p.sku AS product_sku, s.center AS product_distribution_center_id
FROM (
  SELECT line_key AS id, l_partkey AS product_id, created_at::DATE - l_quantity::INT AS created_at,
    created_at::DATE AS sold_at, l_extendedprice::DECIMAL(12,2) AS price,
    (l_extendedprice::DECIMAL(12,2) * (30 + l_partkey % 40)::DECIMAL(4,0) * 0.01)::DECIMAL(12,2) AS cost,
    l_suppkey AS center
  FROM lines
  UNION ALL
  SELECT -(p_partkey * 10 + piece + 1), p_partkey,
    DATE '1998-02-01' + ((p_partkey * 7 + piece * 131) % 1300)::INT, NULL,
    p_retailprice::DECIMAL(12,2), (p_retailprice::DECIMAL(12,2) * 0.5)::DECIMAL(12,2), piece
  FROM (SELECT *, unnest(range(10)) AS piece FROM part)
) AS s LEFT JOIN src_products AS p ON p.id = s.product_id""",
    "src_distribution_centers": """
SELECT s_suppkey AS id, s_name AS name, s_nationkey::DOUBLE AS latitude, s_acctbal AS longitude FROM supplier""",
    "src_events": """
SELECT event_id AS id, user_id,
  if(event_id % 307 = 0, 0, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id))::BIGINT
    AS sequence_number,
  if(event_id % 211 = 0, NULL, user_id::VARCHAR || '-' || ts::DATE::VARCHAR) AS session_id, ts AS created_at,
  NULL::VARCHAR AS ip_address, NULL::VARCHAR AS city, NULL::VARCHAR AS state, NULL::VARCHAR AS postal_code,
  if(user_id % 2 = 0, 'Chrome', 'Safari') AS browser,
  CASE WHEN event_id % 97 = 0 THEN 'Direct' WHEN user_id % 3 = 0 THEN 'Search'
    WHEN user_id % 3 = 1 THEN 'Email' ELSE 'Facebook' END AS traffic_source,
  props AS uri,
  CASE event_type WHEN 'view' THEN 'product' WHEN 'click' THEN 'cart' WHEN 'signup' THEN 'home'
    WHEN 'error' THEN 'cancel' ELSE event_type END AS event_type
FROM events""",
    # -- cleaned --------------------------------------------------------------
    "cleaned_users": f"""
SELECT * REPLACE (coalesce(map {{'Deutschland': 'Germany', 'España': 'Spain', 'Brasil': 'Brazil'}}[country], country)
  AS country)
FROM (SELECT * REPLACE ({trimmed("first_name", "last_name", "email", "gender", "state", "street_address",
    "postal_code", "city", "country", "traffic_source")}) FROM src_users)""",
    "cleaned_products": f"""
SELECT * REPLACE ({trimmed("category", "name", "brand", "department", "sku")}) FROM src_products""",
    "cleaned_orders": f"""
SELECT * REPLACE ({trimmed("status", "gender")}) FROM src_orders""",
    "cleaned_order_items": f"""
SELECT * REPLACE ({trimmed("status")}), coalesce({BAD_DATES}, false)::INT AS invalid_date_sequence_flag
FROM src_order_items""",
    "cleaned_inventory_items": f"""
SELECT * REPLACE ({trimmed("product_category", "product_name", "product_brand", "product_department",
    "product_sku")}) FROM src_inventory_items""",
    "cleaned_distribution_centers": f"""
SELECT * REPLACE ({trimmed("name")}) FROM src_distribution_centers""",
    "cleaned_events": f"""
SELECT * REPLACE ({trimmed("session_id", "ip_address", "city", "state", "postal_code", "browser",
    "traffic_source", "uri", "event_type")}) FROM src_events""",
    # -- star schema ----------------------------------------------------------
    "dim_customer": """
SELECT id AS customer_id, age, gender, city, state, country, traffic_source AS acquisition_source,
  created_at AS customer_created_at, created_at::DATE AS customer_created_date
FROM cleaned_users""",
    "dim_product": """
SELECT id AS product_id, name AS product_name, category, brand, department, sku,
  retail_price::DECIMAL(12,2) AS retail_price
FROM cleaned_products""",
    "dim_distribution_center": """
SELECT id AS distribution_center_id, name AS distribution_center_name, latitude, longitude
FROM cleaned_distribution_centers""",
    "fact_orders": """
SELECT order_id, user_id AS customer_id, status AS order_status,
  created_at AS order_created_at, created_at::DATE AS order_date,
  shipped_at AS order_shipped_at, shipped_at::DATE AS shipped_date,
  delivered_at AS order_delivered_at, delivered_at::DATE AS delivered_date,
  returned_at AS order_returned_at, returned_at::DATE AS returned_date,
  num_of_item AS item_count, (shipped_at IS NOT NULL)::INT AS shipped_flag,
  (delivered_at IS NOT NULL)::INT AS delivered_flag,
  (status IS NOT DISTINCT FROM 'Returned')::INT AS returned_flag,
  (status IS NOT DISTINCT FROM 'Cancelled')::INT AS cancelled_flag,
  (shipped_at::DATE - created_at::DATE)::INT AS days_to_ship,
  (delivered_at::DATE - created_at::DATE)::INT AS days_to_deliver
FROM cleaned_orders""",
    "fact_order_items": """
SELECT i.id AS order_item_id, i.order_id, i.user_id AS customer_id, i.product_id, i.inventory_item_id,
  s.product_distribution_center_id AS distribution_center_id, i.status AS item_status,
  i.created_at AS item_created_at, i.shipped_at AS item_shipped_at, i.delivered_at AS item_delivered_at,
  i.returned_at AS item_returned_at, i.invalid_date_sequence_flag,
  f.order_created_at, f.order_date, f.order_shipped_at, f.shipped_date, f.order_delivered_at,
  f.delivered_date, f.order_returned_at, f.returned_date,
  i.sale_price::DECIMAL(12,2) AS item_revenue, s.cost::DECIMAL(12,2) AS item_cost,
  (i.sale_price::DECIMAL(12,2) - s.cost::DECIMAL(12,2))::DECIMAL(12,2) AS gross_profit_before_returns,
  (i.status IS NOT DISTINCT FROM 'Returned')::INT AS returned_flag,
  (i.status IS NOT DISTINCT FROM 'Cancelled')::INT AS cancelled_flag, f.days_to_ship, f.days_to_deliver
FROM cleaned_order_items AS i, fact_orders AS f, cleaned_inventory_items AS s
WHERE f.order_id = i.order_id AND s.id = i.inventory_item_id""",
    "fact_inventory": """
SELECT id AS inventory_item_id, product_id, product_distribution_center_id AS distribution_center_id,
  created_at AS inventory_created_at, created_at::DATE AS inventory_created_date,
  sold_at AS inventory_sold_at, sold_at::DATE AS inventory_sold_date,
  cost::DECIMAL(12,2) AS inventory_cost, product_retail_price::DECIMAL(12,2) AS product_retail_price,
  (sold_at IS NOT NULL)::INT AS ever_sold_flag, (sold_at::DATE - created_at::DATE)::INT AS days_to_sell
FROM cleaned_inventory_items""",
    "fact_events": """
SELECT id AS event_id, user_id AS customer_id, session_id, sequence_number, created_at AS event_created_at,
  created_at::DATE AS event_date, event_type, traffic_source, browser, uri
FROM cleaned_events""",
    # -- shared cuts ----------------------------------------------------------
    "period_items": f"""
SELECT *, year(order_date)::INT AS order_year, month(order_date)::INT AS order_month,
  item_status = 'Returned' AS came_back, item_status = 'Cancelled' AS called_off
FROM fact_order_items WHERE order_date < {SALES_CUTOFF}""",
    "valid_items": """
SELECT *, if(came_back, 0.00, item_revenue) AS kept_revenue,
  if(came_back, 0.00, gross_profit_before_returns) AS kept_profit
FROM period_items WHERE NOT called_off""",
    "stock": f"""
SELECT *, coalesce(inventory_sold_date < {SALES_CUTOFF}, false) AS sold,
  ({SALES_CUTOFF} - inventory_created_date)::INT AS age_days
FROM fact_inventory WHERE inventory_created_date < {SALES_CUTOFF}""",
    "session_flags": f"""
SELECT session_id, traffic_source, browser, min(event_date) AS session_date,
  coalesce(bool_or(event_type = 'product'), false)::INT AS product_view_flag,
  coalesce(bool_or(event_type = 'cart'), false)::INT AS cart_flag,
  coalesce(bool_or(event_type = 'purchase'), false)::INT AS purchase_flag,
  count(*) AS total_events
FROM fact_events WHERE event_date < {EVENT_CUTOFF} AND session_id IS NOT NULL GROUP BY ALL""",
}


def with_relations(body: str, more: dict[str, str] | None = None) -> str:
    """``body`` behind the relations it names, directly or through others."""
    known = {**RELATIONS, **(more or {})}
    needed: set[str] = set()
    open_texts = [body]
    while open_texts:
        words = set(re.findall(r"\b[a-z_]+\b", open_texts.pop()))
        for name in (words & set(known)) - needed:
            needed.add(name)
            open_texts.append(known[name])
    if not needed:
        return body.strip()
    parts = [f"{name} AS ({known[name].strip()}\n)" for name in known if name in needed]
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()
