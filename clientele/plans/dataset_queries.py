"""Registered queries: sessions, user aggregates, product aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clientele.operators import products as prod, sessions as sess, users as usr
from clientele.operators.sampling import first_n_users, random_n_of_top_m
from clientele.plans.dataset import demo_frames, demo_nested
from clientele.plans.reference_sql import brands_text_sql, demo_sql, product_sql, user_sql
from clientele.plans.registry import query
from clientele.sources import demo


def _money(name: str, alias: str | None = None) -> Column:
    return F.round(F.col(name), 2).alias(alias or name)


def brands_text(brands: str) -> Column:
    """An array of brand structs as text; NULL for an empty array."""
    entry = F.transform(brands, lambda e: F.concat_ws(
        "|", e["brand_name"], e["category"], F.array_join(e["product_ids"].cast("array<string>"), "."),
        e["purchased_items"].cast("string"), e["brand_spend"].cast("decimal(18,2)").cast("string")))
    return F.when(F.size(F.col(brands)) > 0, F.array_join(entry, ";"))


# --------------------------------------------------------------- sessions

@query("events_nested", demo_sql("""
SELECT f.user_id, f.country, f.session_id, f.traffic_source, f.session_created_at, f.n_events,
       round(total_cost, 2) AS total_cost, trail
FROM facts f JOIN (
  SELECT session_id, string_agg(CAST(sequence_number AS VARCHAR) || ':' || event_type || ':' || CAST(product_id AS VARCHAR),
         ',' ORDER BY sequence_number, event_type, product_id) AS trail FROM priced GROUP BY session_id) t
ON f.session_id = t.session_id"""))
def events_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = demo_nested(spark, sf_dir)
    step = F.transform("session", lambda e: F.concat_ws(
        ":", e["sequence_number"].cast("string"), e["event_type"], e["product_id"].cast("string")))
    return events.select("user_id", "country", "session_id", "traffic_source", "session_created_at",
                         F.size("session").cast("long").alias("n_events"), _money("total_cost"),
                         F.array_join(step, ",").alias("trail"))


@query("unnest_session", demo_sql("""
SELECT p.session_id, p.user_id, sequence_number, event_type, product_id,
       p.session_created_at + to_minutes(sequence_number) AS created_at, cost, brand, round(total_cost, 2) AS total_cost
FROM priced p JOIN facts f ON p.session_id = f.session_id"""))
def unnest_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = demo_nested(spark, sf_dir)
    return sess.unnest_session(events).select("session_id", "user_id", "sequence_number", "event_type", "product_id",
                                              "created_at", "cost", "brand", _money("total_cost"))


@query("session_total_cost", demo_sql(
    "SELECT session_id, has_purchase, has_cart, n_events, round(total_cost, 2) AS total_cost FROM facts"))
def session_total_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sess.session_totals(demo_frames(spark, sf_dir).priced).select("session_id", "has_purchase", "has_cart", "n_events",
                                                   _money("total_cost"))


@query("event_uri", demo_sql("SELECT uri, event_type, count(*) AS n FROM priced GROUP BY uri, event_type"))
def event_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo_frames(spark, sf_dir).priced.groupBy("uri", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("sessions_with_event", demo_sql("""
SELECT user_id, session_id, max(session_created_at) AS session_created_at FROM facts WHERE has_cart
GROUP BY user_id, session_id"""))
def sessions_with_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sess.sessions_with(demo_frames(spark, sf_dir).marks, "has_cart")


@query("last_purchase_per_user", user_sql("SELECT user_id, last_purchase_at FROM last_purchase"))
def last_purchase_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sess.last_purchases(demo_frames(spark, sf_dir).marks)


@query("abandoned_cart_sessions", user_sql("SELECT user_id, session_id FROM abandoned"))
def abandoned_cart_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sess.abandoned_carts(demo_frames(spark, sf_dir).marks)


@query("abandoned_cart_sessions_all", user_sql("""
SELECT c.user_id, c.session_id FROM carts c LEFT JOIN last_purchase l ON c.user_id = l.user_id
WHERE l.user_id IS NULL OR c.session_created_at > l.last_purchase_at"""))
def abandoned_cart_sessions_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sess.abandoned_carts(demo_frames(spark, sf_dir).marks, include_never_purchased=True)


@query("abandoned_cart_flag", user_sql("SELECT DISTINCT user_id, has_abandoned_cart FROM ua"))
def abandoned_cart_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = demo_frames(spark, sf_dir)
    return usr.user_global(f.users, f.lines, f.marks, arrays=False).select(
        F.col("id").alias("user_id"), "has_abandoned_cart")


@query("purchase_lines", user_sql(
    "SELECT user_id, session_created_at, session_day, item_cost, brand_name, product_id, category FROM lines"))
def purchase_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo_frames(spark, sf_dir).lines.drop("item_price")


# ------------------------------------------------------------------ users

@query("user_day_brand", user_sql("""
SELECT user_id, session_day, brand_name, category, array_to_string(product_ids, '.') AS product_ids, purchased_items,
       round(CAST(brand_spend AS DOUBLE), 2) AS brand_spend FROM day_brand"""))
def user_day_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usr.user_day_brand(demo_frames(spark, sf_dir).lines).select(
        "user_id", "session_day", "brand_name", "category",
        F.array_join(F.col("product_ids").cast("array<string>"), ".").alias("product_ids"), "purchased_items",
        _money("brand_spend"))


@query("user_brand_global", user_sql("""
SELECT user_id, brand_name, category, array_to_string(product_ids, '.') AS product_ids, purchased_items,
       round(CAST(brand_spend AS DOUBLE), 2) AS brand_spend FROM life_brand"""))
def user_brand_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usr.user_brand_global(demo_frames(spark, sf_dir).lines).select(
        "user_id", "brand_name", "category",
        F.array_join(F.col("product_ids").cast("array<string>"), ".").alias("product_ids"), "purchased_items",
        _money("brand_spend"))


@query("user_day_orders", user_sql("""
SELECT user_id, session_day, daily_purchased_items, round(daily_spend, 2) AS daily_spend FROM day_orders"""))
def user_day_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usr.user_day_orders(demo_frames(spark, sf_dir).lines).select(
        "user_id", "session_day", "daily_purchased_items", _money("daily_spend"))


@query("user_orders_global", user_sql("""
SELECT user_id, total_purchased_items, round(total_spend, 2) AS total_spend, first_purchase_date, last_purchase_date
FROM life_orders"""))
def user_orders_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usr.user_orders_global(demo_frames(spark, sf_dir).lines).select(
        "user_id", "total_purchased_items", _money("total_spend"), "first_purchase_date", "last_purchase_date")


@query("user_daily", user_sql(f"""
SELECT u.id, d.session_day, daily_purchased_items, round(daily_spend, 2) AS daily_spend, brands
FROM users u LEFT JOIN day_orders d ON u.id = d.user_id
LEFT JOIN ({brands_text_sql('day_brand', 'user_id, session_day')}) b
  ON d.user_id = b.user_id AND d.session_day = b.session_day"""))
def user_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = demo_frames(spark, sf_dir)
    return usr.user_daily(f.users, f.lines).select("id", "session_day", "daily_purchased_items",
                                                   _money("daily_spend"), brands_text(usr.DAILY_ARRAY).alias("brands"))


_USER_GLOBAL = f"""
SELECT u.id, age, gender, country, total_purchased_items, round(total_spend, 2) AS total_spend, first_purchase_date,
       last_purchase_date, brands, %s AS has_abandoned_cart
FROM users u LEFT JOIN life_orders l ON u.id = l.user_id
LEFT JOIN ({brands_text_sql('life_brand', 'user_id')}) b ON u.id = b.user_id %s"""


def _user_global(spark: SparkSession, sf_dir: str, dedupe_carts: bool) -> DataFrame:
    f = demo_frames(spark, sf_dir)
    return usr.user_global(f.users, f.lines, f.marks, dedupe_carts=dedupe_carts).select(
        "id", "age", "gender", "country", "total_purchased_items", _money("total_spend"), "first_purchase_date",
        "last_purchase_date", brands_text(usr.TOTAL_ARRAY).alias("brands"), "has_abandoned_cart")


@query("user_global", user_sql(_USER_GLOBAL % ("u.id IN (SELECT user_id FROM abandoned)", "")))
def user_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _user_global(spark, sf_dir, True)


@query("user_global_fanout", user_sql(
    _USER_GLOBAL % ("a.session_id IS NOT NULL", "LEFT JOIN abandoned a ON u.id = a.user_id")))
def user_global_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _user_global(spark, sf_dir, False)


@query("user_aggregates", user_sql(f"""
SELECT ua.user_id, age, gender, country, total_purchased_items, round(total_spend, 2) AS total_spend,
       first_purchase_date, last_purchase_date, ua.session_day, daily_purchased_items,
       round(daily_spend, 2) AS daily_spend, d.brands AS daily_brands, l.brands AS total_brands, has_abandoned_cart
FROM ua LEFT JOIN ({brands_text_sql('day_brand', 'user_id, session_day')}) d
  ON ua.user_id = d.user_id AND ua.session_day = d.session_day
LEFT JOIN ({brands_text_sql('life_brand', 'user_id')}) l ON ua.user_id = l.user_id"""))
def user_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo_frames(spark, sf_dir).user_aggregates().select(
        "user_id", "age", "gender", "country", "total_purchased_items", _money("total_spend"), "first_purchase_date",
        "last_purchase_date", "session_day", "daily_purchased_items", _money("daily_spend"),
        brands_text(usr.DAILY_ARRAY).alias("daily_brands"), brands_text(usr.TOTAL_ARRAY).alias("total_brands"),
        "has_abandoned_cart")


@query("user_aggregates_fanout", user_sql("""
SELECT ua.user_id, ua.session_day, coalesce(k.copies, 1) AS copies,
       coalesce(d.n, 0) * coalesce(k.copies, 1) AS daily_elements,
       coalesce(d.items, 0) * coalesce(k.copies, 1) AS daily_items,
       coalesce(l.n, 0) * coalesce(k.copies, 1) AS total_elements,
       coalesce(l.items, 0) * coalesce(k.copies, 1) AS total_items
FROM ua
LEFT JOIN (SELECT user_id, count(*) AS copies FROM abandoned GROUP BY user_id) k ON ua.user_id = k.user_id
LEFT JOIN (SELECT user_id, session_day, count(*) AS n, CAST(sum(purchased_items) AS BIGINT) AS items FROM day_brand
           GROUP BY ALL) d ON ua.user_id = d.user_id AND ua.session_day = d.session_day
LEFT JOIN (SELECT user_id, count(*) AS n, CAST(sum(purchased_items) AS BIGINT) AS items FROM life_brand
           GROUP BY ALL) l ON ua.user_id = l.user_id"""))
def user_aggregates_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clientele.functions.nested import items_bought
    f = demo_frames(spark, sf_dir)
    rows = usr.with_copies(f.user_aggregates(), f.marks)
    times = F.col("copies")
    return rows.select(
        "user_id", "session_day", "copies",
        (F.size(usr.DAILY_ARRAY) * times).alias("daily_elements"),
        (items_bought(usr.DAILY_ARRAY) * times).alias("daily_items"),
        (F.size(usr.TOTAL_ARRAY) * times).alias("total_elements"),
        (items_bought(usr.TOTAL_ARRAY) * times).alias("total_items"))


@query("count_distinct_ids", demo_sql("""
SELECT count(DISTINCT id) AS n_users, 40 * count(DISTINCT id) / 100.0 AS users_number,
       (SELECT count(DISTINCT id) FROM products) AS n_products FROM users"""))
def count_distinct_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.countDistinct("id")
    people = demo.users(spark, sf_dir).agg(n.alias("n_users"), (F.lit(40) * n / 100.0).cast("double").alias("users_number"))
    goods = demo.products(spark, sf_dir).agg(n.alias("n_products"))
    # both sides are one-row aggregates
    return people.select("*", goods.scalar().alias("n_products"))


@query("first_n_users", demo_sql("""
SELECT id FROM users QUALIFY row_number() OVER (ORDER BY md5(id), id) < (SELECT 40 * count(DISTINCT id) / 100.0 FROM users)"""))
def first_n_users_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_n_users(demo.users(spark, sf_dir).select("id"), percent=40)


@query("random_n_of_top_m", product_sql("""
SELECT brand_name, items FROM (
  SELECT brand_name, CAST(sum(daily_product_purchased_items) AS BIGINT) AS items FROM product_daily
  GROUP BY brand_name ORDER BY items DESC, brand_name LIMIT 20)
ORDER BY md5(brand_name || '-7'), brand_name LIMIT 5"""))
def random_n_of_top_m_(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = prod.product_daily(demo_frames(spark, sf_dir, country=True).priced)
    brands = daily.groupBy("brand_name").agg(F.sum("daily_product_purchased_items").alias("items"))
    return random_n_of_top_m(brands, "brand_name", "items", n=5, m=20, seed=7)


# --------------------------------------------------------------- products

_PD = """SELECT product_id, product_name, brand_name, category, session_day, country, traffic_source,
       daily_product_purchased_items, round(daily_product_spend, 2) AS daily_product_spend FROM product_daily"""


def _product_daily(rows: DataFrame) -> DataFrame:
    return rows.select("product_id", "product_name", "brand_name", "category", "session_day", "country",
                       "traffic_source", "daily_product_purchased_items", _money("daily_product_spend"))


@query("product_daily", product_sql(_PD))
def product_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _product_daily(prod.product_daily(demo_frames(spark, sf_dir, country=True).priced))


@query("product_daily_purchased", demo_sql("""
SELECT product_id, name AS product_name, brand AS brand_name, category,
       date_trunc('day', p.session_created_at) AS session_day, p.country, p.traffic_source,
       count(cost) AS daily_product_purchased_items,
       round(CAST(sum(CAST(cost AS DECIMAL(38,9))) AS DOUBLE), 2) AS daily_product_spend
FROM priced p JOIN facts f ON p.session_id = f.session_id WHERE cost > 0 AND total_cost > 0 GROUP BY ALL"""))
def product_daily_purchased(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = demo_frames(spark, sf_dir, country=True)
    return _product_daily(prod.product_daily(f.priced, f.paid))


@query("product_global", product_sql("""
SELECT product_id, product_name, brand_name, category, product_total_purchased_items,
       round(product_total_spend, 2) AS product_total_spend, last_product_purchase_date FROM product_global"""))
def product_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prod.product_global(demo_frames(spark, sf_dir).priced).select(
        "product_id", "product_name", "brand_name", "category", "product_total_purchased_items",
        _money("product_total_spend"), "last_product_purchase_date")


@query("product_aggregates", product_sql("""
SELECT product_id, product_name, brand_name, category, product_total_purchased_items,
       round(product_total_spend, 2) AS product_total_spend, last_product_purchase_date, session_day,
       daily_product_purchased_items, round(daily_product_spend, 2) AS daily_product_spend, country, traffic_source
FROM pa"""))
def product_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pa = demo_frames(spark, sf_dir, country=True).product_aggregates()
    return (pa.withColumn("product_total_spend", F.round("product_total_spend", 2))
              .withColumn("daily_product_spend", F.round("daily_product_spend", 2)))


@query("distinct_brands", product_sql("SELECT DISTINCT brand_name, category FROM pa"))
def distinct_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prod.distinct_values(demo_frames(spark, sf_dir, country=True).product_aggregates(), "brand_name", "category")


@query("unnest_product_ids", user_sql("""
SELECT user_id, session_day, brand_name, unnest(product_ids) AS product_id FROM day_brand"""))
def unnest_product_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ua = demo_frames(spark, sf_dir).user_aggregates(total=False)
    return (ua.select("user_id", "session_day", F.explode(usr.DAILY_ARRAY).alias("b"))
              .select("user_id", "session_day", "b.brand_name", F.explode("b.product_ids").alias("product_id")))


