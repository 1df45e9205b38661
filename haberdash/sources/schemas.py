"""Declared schemas and keys of the seven raw relations.

Reading never infers a schema: a file that does not fit these fails.
"""

from __future__ import annotations

SOURCE_SCHEMAS: dict[str, str] = {
    "users": (
        "id BIGINT, first_name STRING, last_name STRING, email STRING, age INT, gender STRING, "
        "state STRING, street_address STRING, postal_code STRING, city STRING, country STRING, "
        "latitude DOUBLE, longitude DOUBLE, traffic_source STRING, created_at TIMESTAMP_NTZ"
    ),
    "products": (
        "id BIGINT, cost DOUBLE, category STRING, name STRING, brand STRING, retail_price DOUBLE, "
        "department STRING, sku STRING, distribution_center_id BIGINT"
    ),
    "orders": (
        "order_id BIGINT, user_id BIGINT, status STRING, gender STRING, created_at TIMESTAMP_NTZ, "
        "returned_at TIMESTAMP_NTZ, shipped_at TIMESTAMP_NTZ, delivered_at TIMESTAMP_NTZ, "
        "num_of_item INT"
    ),
    "order_items": (
        "id BIGINT, order_id BIGINT, user_id BIGINT, product_id BIGINT, inventory_item_id BIGINT, "
        "status STRING, created_at TIMESTAMP_NTZ, shipped_at TIMESTAMP_NTZ, "
        "delivered_at TIMESTAMP_NTZ, returned_at TIMESTAMP_NTZ, sale_price DOUBLE"
    ),
    "inventory_items": (
        "id BIGINT, product_id BIGINT, created_at TIMESTAMP_NTZ, sold_at TIMESTAMP_NTZ, "
        "cost DOUBLE, product_category STRING, product_name STRING, product_brand STRING, "
        "product_retail_price DOUBLE, product_department STRING, product_sku STRING, "
        "product_distribution_center_id BIGINT"
    ),
    "distribution_centers": "id BIGINT, name STRING, latitude DOUBLE, longitude DOUBLE",
    "events": (
        "id BIGINT, user_id BIGINT, sequence_number BIGINT, session_id STRING, "
        "created_at TIMESTAMP_NTZ, ip_address STRING, city STRING, state STRING, "
        "postal_code STRING, browser STRING, traffic_source STRING, uri STRING, event_type STRING"
    ),
}

SOURCE_KEYS: dict[str, str] = {
    name: "order_id" if name == "orders" else "id" for name in SOURCE_SCHEMAS
}

MODEL_KEYS: dict[str, str] = {
    "dim_customer": "customer_id",
    "dim_product": "product_id",
    "dim_distribution_center": "distribution_center_id",
    "fact_orders": "order_id",
    "fact_order_items": "order_item_id",
    "fact_inventory": "inventory_item_id",
    "fact_events": "event_id",
}
