"""SQL definitions of the shop's tables and shared intermediate results, used only by the checks.

``v_`` views have the customer grain, ``y_`` views the customer-year grain of ``driver_tables``.
"""

from __future__ import annotations

from patronlens import constants as C
from patronlens.plans.driver_tables import ODD_CITIES

_STATES = "[" + ", ".join(f"'{s}'" for s in C.STATES) + "]"
_ODD = " ".join(f"WHEN {k} THEN '{v}'" for k, v in ODD_CITIES.items())
_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped' WHEN 'P' THEN 'canceled' END"



def draw_sql(column: str, seed: int) -> str:
    """``functions.expressions.draw`` in SQL."""
    return f"CAST('0x' || substr(md5('{seed}:' || CAST({column} AS VARCHAR)), 1, 15) AS BIGINT)"


class _Views(dict):
    def __setitem__(self, name: str, sql: str) -> None:
        if name in self:
            raise ValueError(f"view {name} is defined twice")
        super().__setitem__(name, sql)


VIEWS: dict[str, str] = _Views()

VIEWS["v_customers"] = f"""
SELECT c_custkey AS customer_id, c_custkey AS customer_unique_id, c_nationkey AS customer_zip_code_prefix,
       lower(n_name) AS customer_city, list_extract({_STATES}, c_nationkey + 1) AS customer_state
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"""

VIEWS["y_customers"] = """
SELECT o_orderkey AS customer_id, o_custkey * 10000 + year(o_orderdate) AS customer_unique_id,
       customer_zip_code_prefix, customer_city, customer_state
FROM orders JOIN v_customers c ON o_custkey = c.customer_id"""

VIEWS["v_orders"] = f"""
SELECT o_orderkey AS order_id, o_custkey AS customer_id, {_STATUS} AS order_status,
       o_orderdate AS order_purchase_timestamp FROM orders"""

VIEWS["y_orders"] = f"""
SELECT o_orderkey AS order_id, o_orderkey AS customer_id, {_STATUS} AS order_status,
       o_orderdate AS order_purchase_timestamp FROM orders"""

VIEWS["v_raw_orders"] = """
SELECT order_id, customer_id, order_status, order_purchase_timestamp, order_purchase_timestamp AS order_approved_at,
       lo AS order_delivered_carrier_date, hi AS order_delivered_customer_date,
       order_purchase_timestamp + INTERVAL 30 DAY AS order_estimated_delivery_date
FROM v_orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem GROUP BY 1)
  ON order_id = l_orderkey"""

VIEWS["v_payments"] = """
SELECT o_orderkey AS _row, o_orderkey AS order_id,
       CASE WHEN kind = 'not specified' THEN 'not_defined' ELSE kind END AS payment_type, o_totalprice AS payment_value
FROM (SELECT *, lower(substring(o_orderpriority, 3, 30)) AS kind FROM orders)"""

VIEWS["v_items"] = """
SELECT ((CAST(l_linenumber AS BIGINT) * 10000000 + l_partkey) * 100000 + l_suppkey) * 64 + CAST(l_quantity AS BIGINT) AS _row, l_orderkey AS order_id, l_partkey AS product_id, l_suppkey AS seller_id,
       l_shipdate AS shipping_limit_date, l_extendedprice AS price, l_extendedprice * l_tax AS freight_value
FROM lineitem"""

VIEWS["v_reviews"] = """
SELECT ((CAST(l_linenumber AS BIGINT) * 10000000 + l_partkey) * 100000 + l_suppkey) * 64 + CAST(l_quantity AS BIGINT) AS _row, l_orderkey AS order_id,
       CASE WHEN l_returnflag <> 'N' THEN 1.0 + l_quantity % 5 END AS review_score FROM lineitem"""

VIEWS["v_products"] = """
SELECT p_partkey AS product_id, lower(p_brand) AS product_category_name, CAST(length(p_name) AS INTEGER) AS product_name_lenght,
       CASE WHEN p_size > 2 THEN p_size END AS product_description_lenght FROM part"""

VIEWS["v_translation"] = """
SELECT min(p_partkey) AS _row, lower(p_brand) AS product_category_name, upper(p_brand) AS product_category_name_english
FROM part WHERE p_brand < (SELECT max(p_brand) FROM part) GROUP BY p_brand
UNION ALL
SELECT min(p_partkey), lower(p_type), 'kind ' || lower(p_type) FROM part GROUP BY p_type"""

VIEWS["v_tree"] = """
SELECT DISTINCT 'group_' || right(p_brand, 1) AS upper_category, upper(p_brand) AS name FROM part
WHERE right(p_brand, 1) <> '9'"""

VIEWS["v_sellers"] = f"""
SELECT s_suppkey AS _row, s_suppkey AS seller_id, s_nationkey AS seller_zip_code_prefix,
       CASE s_nationkey {_ODD} ELSE lower(n_name) END AS seller_city
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey"""

VIEWS["v_geo"] = f"""
SELECT vec_id AS _row, label * 3 AS geolocation_zip_code_prefix,
       round(CAST(embedding[1] AS DOUBLE), 3) AS geolocation_lat, round(CAST(embedding[2] AS DOUBLE), 3) AS geolocation_lng,
       'city ' || (vec_id % 4) AS geolocation_city, list_extract({_STATES}, CAST(vec_id % 3 AS INTEGER) + 1) AS geolocation_state
FROM embeddings"""

VIEWS["v_event_orders"] = """
SELECT event_id AS order_id, user_id AS customer_unique_id, ts AS order_purchase_timestamp, value AS payment_value,
       CAST(1 + event_id % 5 AS DOUBLE) AS review_score, event_type AS upper_category,
       CAST(event_id % 25 AS INTEGER) AS seller_zip_code_prefix, CAST(user_id % 25 AS INTEGER) AS customer_zip_code_prefix
FROM events"""
