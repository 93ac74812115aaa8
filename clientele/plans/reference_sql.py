"""Building blocks of the SQL the results are checked against (DuckDB dialect).

The same definitions as `sources.demo` and `operators`, written a second time as
plain SQL over the provided tables."""

from __future__ import annotations

AS_OF = "DATE '2001-08-01'"

_DEMO = """
users AS (
  SELECT CAST(c_custkey AS VARCHAR) AS id, 'Customer' AS first_name, c_name AS last_name,
         CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender, 18 + c_custkey % 60 AS age,
         c_mktsegment AS state, n_name AS country, lower(c_name) || '@example.com' AS email
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey),
products AS (
  SELECT p_partkey + 1 AS id, p_retailprice AS cost, p_type AS category, p_name AS name, p_brand AS brand,
         p_retailprice AS retail_price, CASE WHEN p_size <= 25 THEN 'Women' ELSE 'Men' END AS department,
         'SKU-' || CAST(p_partkey AS VARCHAR) AS sku, CAST(p_size AS BIGINT) AS distribution_center_id
  FROM part),
heads AS (
  SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS session_id, u.id AS user_id, u.country, o_orderstatus AS status,
         o_orderdate AS session_created_at,
         CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Search' WHEN '2' THEN 'Organic' WHEN '3' THEN 'Email'
              WHEN '4' THEN 'Facebook' ELSE 'Display' END AS traffic_source
  FROM orders JOIN users u ON u.id = CAST(o_custkey AS VARCHAR)),
ends AS (SELECT l_orderkey, max(CAST(l_linenumber AS BIGINT)) AS last_no FROM lineitem GROUP BY l_orderkey),
around AS (SELECT heads.*, last_no FROM heads JOIN ends ON o_orderkey = l_orderkey),
raw AS (
  SELECT user_id, country, session_id, traffic_source, session_created_at,
         CASE WHEN l_returnflag = 'R' THEN 'department' ELSE 'product' END AS event_type,
         l_partkey + 1 AS product_id, CAST(l_linenumber AS BIGINT) AS sequence_number
  FROM lineitem JOIN heads ON l_orderkey = o_orderkey
  UNION ALL
  SELECT user_id, country, session_id, traffic_source, session_created_at, 'home', 0, 0
  FROM around WHERE o_orderkey % 2 = 0
  UNION ALL
  SELECT user_id, country, session_id, traffic_source, session_created_at, 'cart', 0, last_no + 1
  FROM around WHERE status IN ('F', 'P')
  UNION ALL
  SELECT user_id, country, session_id, traffic_source, session_created_at,
         CASE WHEN status = 'F' THEN 'purchase' ELSE 'cancel' END, 0, last_no + 2
  FROM around WHERE status IN ('F', 'P')),
priced AS (
  SELECT raw.*, cost, category, name, brand, department,
         CASE event_type
           WHEN 'department' THEN '/department/' || replace(lower(department), ' ', '') || '/category/'
                || replace(lower(category), ' ', '') || '/brand/' || replace(lower(brand), ' ', '')
           WHEN 'product' THEN '/product/' || CAST(product_id AS VARCHAR) END AS uri
  FROM raw LEFT JOIN products ON raw.product_id = products.id),
facts AS (
  SELECT user_id, country, session_id, session_created_at, traffic_source,
         bool_or(event_type = 'purchase') AS has_purchase, bool_or(event_type = 'cart') AS has_cart,
         CASE WHEN bool_or(event_type = 'purchase') THEN CAST(sum(CAST(cost AS DECIMAL(38,9))) AS DOUBLE) ELSE 0 END
           AS total_cost,
         count(*) AS n_events
  FROM priced GROUP BY user_id, country, session_id, session_created_at, traffic_source)"""

_USERS = """
lines AS (
  SELECT p.user_id, p.session_created_at, date_trunc('day', p.session_created_at) AS session_day, cost AS item_cost,
         brand AS brand_name, product_id, category
  FROM priced p JOIN facts f ON p.session_id = f.session_id WHERE f.total_cost > 0 AND cost > 0),
day_brand AS (
  SELECT user_id, session_day, brand_name, string_agg(DISTINCT category, ',' ORDER BY category) AS category,
         list_sort(list(DISTINCT product_id)) AS product_ids, count(*) AS purchased_items,
         sum(CAST(item_cost AS DECIMAL(38,9))) AS brand_spend
  FROM lines GROUP BY user_id, session_day, brand_name),
life_brand AS (
  SELECT user_id, brand_name, string_agg(DISTINCT category, ',' ORDER BY category) AS category,
         list_sort(list(DISTINCT product_id)) AS product_ids, count(*) AS purchased_items,
         sum(CAST(item_cost AS DECIMAL(38,9))) AS brand_spend
  FROM lines GROUP BY user_id, brand_name),
day_orders AS (
  SELECT user_id, session_day, count(item_cost) AS daily_purchased_items,
         CAST(sum(CAST(item_cost AS DECIMAL(38,9))) AS DOUBLE) AS daily_spend
  FROM lines GROUP BY user_id, session_day),
life_orders AS (
  SELECT user_id, count(item_cost) AS total_purchased_items,
         CAST(sum(CAST(item_cost AS DECIMAL(38,9))) AS DOUBLE) AS total_spend,
         min(session_created_at) AS first_purchase_date, max(session_created_at) AS last_purchase_date
  FROM lines GROUP BY user_id),
last_purchase AS (
  SELECT user_id, max(session_created_at) AS last_purchase_at FROM facts WHERE has_purchase GROUP BY user_id),
carts AS (
  SELECT user_id, session_id, max(session_created_at) AS session_created_at
  FROM facts WHERE has_cart GROUP BY user_id, session_id),
abandoned AS (
  SELECT c.user_id, c.session_id FROM carts c LEFT JOIN last_purchase l ON c.user_id = l.user_id
  WHERE c.session_created_at > l.last_purchase_at),
ua AS (
  SELECT u.id AS user_id, age, gender, country, total_purchased_items, total_spend, first_purchase_date,
         last_purchase_date, d.session_day, d.daily_purchased_items, d.daily_spend,
         u.id IN (SELECT user_id FROM abandoned) AS has_abandoned_cart
  FROM users u LEFT JOIN life_orders l ON u.id = l.user_id LEFT JOIN day_orders d ON u.id = d.user_id)"""

_PRODUCTS = """
product_daily AS (
  SELECT product_id, name AS product_name, brand AS brand_name, category,
         date_trunc('day', session_created_at) AS session_day, country, traffic_source,
         count(cost) AS daily_product_purchased_items,
         CAST(sum(CAST(cost AS DECIMAL(38,9))) AS DOUBLE) AS daily_product_spend
  FROM priced WHERE cost > 0 GROUP BY ALL),
product_global AS (
  SELECT product_id, name AS product_name, brand AS brand_name, category,
         count(*) AS product_total_purchased_items,
         CAST(sum(CAST(cost AS DECIMAL(38,9))) AS DOUBLE) AS product_total_spend,
         max(session_created_at) AS last_product_purchase_date
  FROM priced WHERE product_id <> 0 GROUP BY ALL),
pa AS (
  SELECT g.product_id, g.product_name, g.brand_name, g.category, g.product_total_purchased_items,
         g.product_total_spend, g.last_product_purchase_date, d.session_day, d.daily_product_purchased_items,
         d.daily_product_spend, d.country, d.traffic_source
  FROM product_global g JOIN product_daily d ON g.product_id = d.product_id)"""


def demo_sql(body: str) -> str:
    return f"WITH {_DEMO}\n{body}"


def user_sql(body: str) -> str:
    return f"WITH {_DEMO},{_USERS}\n{body}"


def product_sql(body: str) -> str:
    return f"WITH {_DEMO},{_PRODUCTS}\n{body}"


def all_sql(body: str) -> str:
    return f"WITH {_DEMO},{_USERS},{_PRODUCTS}\n{body}"


def brands_text_sql(table: str, keys: str) -> str:
    """Brand structs of a group as one text, for comparing arrays by value."""
    return f"""SELECT {keys}, string_agg(brand_name || '|' || category || '|' || array_to_string(product_ids, '.')
           || '|' || CAST(purchased_items AS VARCHAR) || '|' || CAST(CAST(brand_spend AS DECIMAL(18,2)) AS VARCHAR),
           ';' ORDER BY brand_name) AS brands FROM {table} GROUP BY {keys}"""
