"""Product aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clientele.functions.dates import day_of, day_start, within
from clientele.functions.money import as_money, numeric
from clientele.operators.sessions import FACT_KEYS, NO_PRODUCT

def _product_keys() -> list[Column]:
    return [F.col("product_id"), F.col("name").alias("product_name"), F.col("brand").alias("brand_name"),
            F.col("category")]


def _price(priced: DataFrame) -> Column:
    return F.col("price") if "price" in priced.columns else numeric(F.col("cost"))


def product_base(priced: DataFrame) -> DataFrame:
    """Per product, day, country and source: all events, those with a price above 0,
    both sums and the latest instant. Days and lifetime are rolled up from it, so the
    events are shuffled once."""
    above = F.col("cost") > 0
    return (priced.groupBy(*_product_keys(), day_start(F.col("session_created_at")).alias("session_day"),
                           "country", "traffic_source")
            .agg(F.count(F.lit(1)).alias("n_events"), F.count(F.when(above, 1)).alias("n_priced"),
                 F.sum(_price(priced)).alias("all_money"), F.sum(F.when(above, _price(priced))).alias("priced_money"),
                 F.max("session_created_at").alias("latest")))


_PRODUCT = ["product_id", "product_name", "brand_name", "category"]


def product_daily(priced: DataFrame, paid: DataFrame | None = None) -> DataFrame:
    """Items and money per product, day, country and source.

    Counts every priced event, bought or only looked at; pass the paid sessions
    to count purchases only."""
    rows = priced.where(F.col("cost") > 0)
    if paid is not None:
        rows = rows.join(paid, FACT_KEYS, "left_semi")
    return daily_of(product_base(rows))


def daily_of(base: DataFrame) -> DataFrame:
    return base.where("n_priced > 0").select(
        *_PRODUCT, "session_day", "country", "traffic_source", F.col("n_priced").alias("daily_product_purchased_items"),
        as_money(F.col("priced_money")).alias("daily_product_spend"))


def product_global(priced: DataFrame) -> DataFrame:
    """Lifetime totals per product; the 'no product' id 0 is left out. Straight from the
    events, where the days are not needed."""
    return (priced.where(F.col("product_id") != NO_PRODUCT).groupBy(*_product_keys())
            .agg(F.count(F.lit(1)).alias("product_total_purchased_items"),
                 as_money(F.sum(_price(priced))).alias("product_total_spend"),
                 F.max("session_created_at").alias("last_product_purchase_date")))


def global_of(base: DataFrame) -> DataFrame:
    """The same, rolled up from the days."""
    return (base.where(F.col("product_id") != NO_PRODUCT).groupBy(*_PRODUCT)
            .agg(F.sum("n_events").alias("product_total_purchased_items"),
                 as_money(F.sum("all_money")).alias("product_total_spend"),
                 F.max("latest").alias("last_product_purchase_date")))


def product_aggregates(global_: DataFrame, daily: DataFrame) -> DataFrame:
    """Lifetime columns repeated on every daily row; joined on the id only."""
    days = daily.select("product_id", "session_day", "daily_product_purchased_items", "daily_product_spend",
                        "country", "traffic_source")
    return global_.join(days, "product_id").select(
        "product_id", "product_name", "brand_name", "category", "product_total_purchased_items",
        "product_total_spend", "last_product_purchase_date", "session_day", "daily_product_purchased_items",
        "daily_product_spend", "country", "traffic_source")


def top_products(aggregates: DataFrame, by: str = "product_name", k: int = 5, since: Column | None = None,
                 until: Column | None = None) -> DataFrame:
    """The k products with most items in a range of days; equal counts go by key."""
    return (aggregates.where(within(day_of(F.col("session_day")), since, until))
            .groupBy(by).agg(F.sum("daily_product_purchased_items").alias("total_purchased_items"))
            .orderBy(F.desc("total_purchased_items"), by).limit(k))


def distinct_values(aggregates: DataFrame, *columns: str) -> DataFrame:
    """Listing of brands, categories or products without repeats."""
    return aggregates.select(*columns).distinct()
