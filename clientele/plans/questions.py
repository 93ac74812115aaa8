"""The sample questions about users and products, as segment plans.

`ua` is user_aggregates, `pa` product_aggregates; `as_of` stands for today.
Each returns the ids of the users that match (seg_q0: the products)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clientele.functions.dates import DateLike, as_date, days_before, months_before
from clientele.operators.products import top_products
from clientele.operators.segments import Segment, segment


def top_sellers(pa: DataFrame, as_of: DateLike = None, months: int = 3, k: int = 5) -> DataFrame:
    """The k most purchased products of the last months."""
    return top_products(pa, "product_name", k, since=months_before(as_of, months))


def spenders_of_brand(ua: DataFrame, brand: str, as_of: DateLike = None, total: float = 50, items: int = 2,
                      months: int = 3, weight=None) -> Segment:
    """More than `total` spent so far, and some items of a brand lately."""
    return (segment(ua).where_attr(F.col("total_spend") > total)
            .bought(brand, min_items=items, since=months_before(as_of, months), weight=weight))


def young_locals_before(ua: DataFrame, brand: str, country: str, day: DateLike, age: int = 35) -> Segment:
    """Under an age, in a country, bought a brand before a day."""
    return (segment(ua).where_attr((F.col("age") < age) & (F.col("country") == country))
            .bought_before(brand, as_date(day)))


def young_lapsed(ua: DataFrame, brand: str, day: DateLike, age: int = 35) -> Segment:
    """Under an age, bought a brand once, but not after a day."""
    return (segment(ua).where_attr(F.col("age") < age)
            .bought_ever(brand, over_items=0).not_bought(brand, after=as_date(day)))


def recent_spenders(ua: DataFrame, as_of: DateLike = None, amount: float = 1000, months: int = 3,
                    weight=None) -> Segment:
    """Spent an amount in the last months."""
    return segment(ua).spent(amount, since=months_before(as_of, months), until=as_date(as_of), weight=weight)


def loyal_without(ua: DataFrame, brand: str, other: str, as_of: DateLike = None, spend: float = 100,
                  days: int = 90) -> Segment:
    """Spent more than an amount on one brand, nothing on another one lately."""
    return (segment(ua).bought_ever(brand, over_spend=spend)
            .not_bought(other, since=days_before(as_of, days), until=as_date(as_of)))


def repeat_buyers(ua: DataFrame, brand: str, as_of: DateLike = None, items: int = 2, months: int = 12,
                  weight=None) -> Segment:
    """Some items of a brand in the last year."""
    return segment(ua).bought(brand, min_items=items, since=months_before(as_of, months), until=as_date(as_of),
                              weight=weight)


def buyers_of_top(ua: DataFrame, pa: DataFrame, as_of: DateLike = None, k: int = 5, months: int = 3,
                  at_least: int = 1) -> DataFrame:
    """Bought at least so many of the k most purchased products lately.

    The top list has k rows by construction, so Spark may broadcast it."""
    since, until = months_before(as_of, months), as_date(as_of)
    top = top_products(pa, "product_id", k, since=since, until=until)
    return segment(ua).bought_one_of(top, at_least=at_least, since=since, until=until)
