"""Registered queries: the sample questions, per row and per user."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from clientele.operators import users as usr
from clientele.operators.products import top_products
from clientele.operators.segments import Segment, count_both, segment
from clientele.plans import questions as q
from clientele.plans.dataset import demo_frames
from clientele.plans.reference_sql import AS_OF, all_sql, product_sql, user_sql
from clientele.plans.registry import query
from clientele.sources import demo
from clientele.functions.dates import as_date, months_before

BRAND, OTHER, COUNTRY = "Brand#4", "Brand#7", "NATION_3"
CUT_DAY = dt.date(1999, 8, 1)


def _answer(ids: DataFrame | Segment) -> DataFrame:
    """The count, and whether the approximate one is close to it."""
    counts = count_both(ids.users() if isinstance(ids, Segment) else ids)
    close = F.abs(F.col("user_count") - F.col("user_count_exact")) <= F.ceil(F.col("user_count_exact") * 0.1)
    return counts.select("user_count_exact", close.alias("approx_is_close"))


def _count_sql(ids: str) -> str:
    return f"SELECT count(DISTINCT user_id) AS user_count_exact, TRUE AS approx_is_close FROM ({ids})"


# One day row with its brand (if any) of interest.
_DAY = """(SELECT ua.*, b.purchased_items AS items FROM ua LEFT JOIN day_brand b
   ON ua.user_id = b.user_id AND ua.session_day = b.session_day AND b.brand_name = '{brand}')"""
_DAY_BRAND = _DAY.format(brand=BRAND)
_DAY_OTHER = _DAY.format(brand=OTHER)


def _products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily columns do; the lifetime table would be joined for nothing."""
    return demo_frames(spark, sf_dir, country=True).product_daily()


def _months(n: int, column: str = "session_day") -> str:
    return (f"CAST({column} AS DATE) BETWEEN CAST({AS_OF} - INTERVAL {n} MONTH AS DATE) AND {AS_OF}")


@query("top_products", product_sql(f"""
SELECT product_name, CAST(sum(daily_product_purchased_items) AS BIGINT) AS total_purchased_items FROM pa
WHERE CAST(session_day AS DATE) >= CAST({AS_OF} - INTERVAL 3 MONTH AS DATE)
GROUP BY product_name ORDER BY total_purchased_items DESC, product_name LIMIT 5"""))
def top_products_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.top_sellers(_products(spark, sf_dir), demo.AS_OF)


@query("seg_q0", product_sql(f"""
SELECT product_id, CAST(sum(daily_product_purchased_items) AS BIGINT) AS total_purchased_items FROM pa
WHERE {_months(12)} GROUP BY product_id ORDER BY total_purchased_items DESC, product_id LIMIT 5"""))
def seg_q0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(_products(spark, sf_dir), "product_id", 5,
                        since=months_before(demo.AS_OF, 12), until=as_date(demo.AS_OF))


_Q1 = (f"SELECT user_id FROM {_DAY_BRAND} WHERE total_spend > 50 AND items >= 2 "
       f"AND CAST(session_day AS DATE) >= CAST({AS_OF} - INTERVAL 24 MONTH AS DATE)")


@query("seg_q1", user_sql(_count_sql(_Q1)))
def seg_q1(spark: SparkSession, sf_dir: str) -> DataFrame:
    ua = demo_frames(spark, sf_dir).user_aggregates(total=False)
    return _answer(q.spenders_of_brand(ua, BRAND, demo.AS_OF, months=24))


@query("seg_q1_user", user_sql(_count_sql(f"""
SELECT user_id FROM {_DAY_BRAND} WHERE total_spend > 50
AND CAST(session_day AS DATE) >= CAST({AS_OF} - INTERVAL 24 MONTH AS DATE) GROUP BY user_id HAVING sum(items) >= 2""")))
def seg_q1_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    ua = demo_frames(spark, sf_dir).user_aggregates(total=False)
    return _answer(q.spenders_of_brand(ua, BRAND, demo.AS_OF, months=24).per_user())


@query("seg_q2", user_sql(_count_sql(f"""
SELECT user_id FROM {_DAY_BRAND} WHERE age < 35 AND country = '{COUNTRY}' AND items IS NOT NULL
AND CAST(session_day AS DATE) < DATE '{CUT_DAY}'""")))
def seg_q2(spark: SparkSession, sf_dir: str) -> DataFrame:
    ua = demo_frames(spark, sf_dir).user_aggregates(total=False)
    return _answer(q.young_locals_before(ua, BRAND, COUNTRY, CUT_DAY))


_LAPSED = f"""SELECT {{what}} FROM {_DAY_BRAND} WHERE age < 35
AND user_id IN (SELECT user_id FROM life_brand WHERE brand_name = '{BRAND}' AND purchased_items > 0)"""
_AFTER = f"(items IS NOT NULL AND CAST(session_day AS DATE) > DATE '{CUT_DAY}')"


@query("seg_q3", user_sql(_count_sql(_LAPSED.format(what="user_id") + f" AND NOT coalesce({_AFTER}, FALSE)")))
def seg_q3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(q.young_lapsed(demo_frames(spark, sf_dir).user_aggregates(), BRAND, CUT_DAY))


_Q3_USER = user_sql(_count_sql(
    _LAPSED.format(what="user_id") + f" GROUP BY user_id HAVING NOT coalesce(bool_or({_AFTER}), FALSE)"))


@query("seg_q3_user", _Q3_USER)
def seg_q3_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(q.young_lapsed(demo_frames(spark, sf_dir).user_aggregates(), BRAND, CUT_DAY).per_user())


@query("seg_anti_user_scope", _Q3_USER)
def seg_anti_user_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seg_q3_user as an anti join of two segments."""
    ua = demo_frames(spark, sf_dir).user_aggregates()
    once = segment(ua).where_attr(F.col("age") < 35).bought_ever(BRAND, over_items=0)
    lately = segment(ua).where_attr(F.to_date("session_day") > as_date(CUT_DAY)).bought(BRAND)
    return _answer(once.except_(lately))


@query("seg_q4", user_sql(_count_sql(f"""
SELECT ua.user_id FROM ua JOIN (SELECT user_id, session_day, count(*) AS n FROM day_brand GROUP BY ALL) d
ON ua.user_id = d.user_id AND ua.session_day = d.session_day
WHERE daily_spend * n >= 10000 AND {_months(3, 'ua.session_day')}""")))
def seg_q4(spark: SparkSession, sf_dir: str) -> DataFrame:
    ua = demo_frames(spark, sf_dir).user_aggregates(total=False)
    return _answer(q.recent_spenders(ua, demo.AS_OF, amount=10000))


@query("seg_q4_user", user_sql(_count_sql(
    f"SELECT user_id FROM ua WHERE {_months(3)} GROUP BY user_id HAVING sum(daily_spend) >= 10000")))
def seg_q4_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    ua = demo_frames(spark, sf_dir).user_aggregates(total=False)
    return _answer(q.recent_spenders(ua, demo.AS_OF, amount=10000).per_user())


_LOYAL = f"""SELECT user_id FROM {_DAY_OTHER}
WHERE user_id IN (SELECT user_id FROM life_brand WHERE brand_name = '{BRAND}' AND brand_spend > 100)"""
_RECENT = (f"(items IS NOT NULL AND CAST(session_day AS DATE) BETWEEN CAST({AS_OF} - INTERVAL 90 DAY AS DATE) "
           f"AND {AS_OF})")


@query("seg_q5", user_sql(_count_sql(f"{_LOYAL} AND NOT coalesce({_RECENT}, FALSE)")))
def seg_q5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(q.loyal_without(demo_frames(spark, sf_dir).user_aggregates(), BRAND, OTHER, demo.AS_OF))


@query("seg_q5_user", user_sql(_count_sql(
    f"{_LOYAL} GROUP BY user_id HAVING NOT coalesce(bool_or({_RECENT}), FALSE)")))
def seg_q5_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(q.loyal_without(demo_frames(spark, sf_dir).user_aggregates(), BRAND, OTHER, demo.AS_OF).per_user())


@query("seg_q6", user_sql(_count_sql(f"SELECT user_id FROM {_DAY_BRAND} WHERE items >= 2 AND {_months(12)}")))
def seg_q6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(q.repeat_buyers(demo_frames(spark, sf_dir).user_aggregates(total=False), BRAND, demo.AS_OF))


@query("seg_q6_user", user_sql(_count_sql(
    f"SELECT user_id FROM {_DAY_BRAND} WHERE {_months(12)} GROUP BY user_id HAVING sum(items) >= 2")))
def seg_q6_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    ua = demo_frames(spark, sf_dir).user_aggregates(total=False)
    return _answer(q.repeat_buyers(ua, BRAND, demo.AS_OF).per_user())


# The same three questions over arrays repeated once per abandoned cart.
_COPIES = "LEFT JOIN (SELECT user_id, count(*) AS copies FROM abandoned GROUP BY user_id) k ON x.user_id = k.user_id"


def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = demo_frames(spark, sf_dir)
    return usr.with_copies(f.user_aggregates(total=False), f.marks)


@query("seg_q1_fanout", user_sql(_count_sql(f"""
SELECT x.user_id FROM {_DAY_BRAND} x {_COPIES} WHERE total_spend > 50 AND items * coalesce(copies, 1) >= 2
AND CAST(session_day AS DATE) >= CAST({AS_OF} - INTERVAL 24 MONTH AS DATE)""")))
def seg_q1_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(q.spenders_of_brand(_weighted(spark, sf_dir), BRAND, demo.AS_OF, months=24, weight=F.col("copies")))


@query("seg_q4_fanout", user_sql(_count_sql(f"""
SELECT x.user_id FROM ua x JOIN (SELECT user_id, session_day, count(*) AS n FROM day_brand GROUP BY ALL) d
ON x.user_id = d.user_id AND x.session_day = d.session_day {_COPIES}
WHERE daily_spend * n * coalesce(copies, 1) >= 10000 AND {_months(3, 'x.session_day')}""")))
def seg_q4_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(q.recent_spenders(_weighted(spark, sf_dir), demo.AS_OF, amount=10000, weight=F.col("copies")))


@query("seg_q6_fanout", user_sql(_count_sql(f"""
SELECT x.user_id FROM {_DAY_BRAND} x {_COPIES} WHERE items * coalesce(copies, 1) >= 2 AND {_months(12)}""")))
def seg_q6_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(q.repeat_buyers(_weighted(spark, sf_dir), BRAND, demo.AS_OF, weight=F.col("copies")))


def _top_sql(months: int, at_least: int) -> str:
    return all_sql(_count_sql(f"""
SELECT user_id FROM (SELECT user_id, session_day, unnest(product_ids) AS product_id FROM day_brand)
WHERE product_id IN (SELECT product_id FROM pa WHERE {_months(months)} GROUP BY product_id
  ORDER BY sum(daily_product_purchased_items) DESC, product_id LIMIT 5) AND {_months(months)}
GROUP BY user_id HAVING count(DISTINCT product_id) >= {at_least}"""))


@query("seg_q7", _top_sql(3, 1))
def seg_q7(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = demo_frames(spark, sf_dir)
    return _answer(q.buyers_of_top(f.user_aggregates(total=False), _products(spark, sf_dir), demo.AS_OF, months=3))


@query("seg_q8", _top_sql(12, 2))
def seg_q8(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = demo_frames(spark, sf_dir)
    return _answer(q.buyers_of_top(f.user_aggregates(total=False), _products(spark, sf_dir), demo.AS_OF, months=12,
                                   at_least=2))


_A = f"SELECT DISTINCT user_id FROM life_brand WHERE brand_name = '{BRAND}'"
_B = f"SELECT DISTINCT user_id FROM life_brand WHERE brand_name = '{OTHER}'"


@query("seg_q7_user", user_sql(_count_sql(f"""
WITH top AS (SELECT product_id FROM (SELECT l_partkey + 1 AS product_id, count(*) AS n FROM lineitem GROUP BY 1
             ORDER BY n DESC, product_id LIMIT 5)),
spender AS (SELECT user_id FROM {_DAY_BRAND} GROUP BY user_id HAVING sum(items) >= 2)
SELECT DISTINCT lines.user_id FROM lines JOIN spender USING (user_id) WHERE product_id IN (SELECT product_id FROM top)""")))
def seg_q7_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with two items of a brand over all their days who bought a product of the
    list on any day. The list is by lines, so it needs no product table."""
    top = (demo.table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") + 1).alias("product_id"))
           .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "product_id").limit(5))
    ua = demo_frames(spark, sf_dir).user_aggregates(total=False)
    return _answer(segment(ua).bought(BRAND, min_items=2).per_user().bought_one_of(top))


@query("seg_set_ops", user_sql(f"""
SELECT user_id, 'both' AS part FROM (({_A}) INTERSECT ({_B}))
UNION ALL SELECT user_id, 'first only' FROM (({_A}) EXCEPT ({_B}))
UNION ALL SELECT user_id, 'either' FROM (({_A}) UNION ({_B}))"""))
def seg_set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    ua = demo_frames(spark, sf_dir).user_aggregates()
    a, b = segment(ua).bought_ever(BRAND), segment(ua).bought_ever(OTHER)
    return (a.intersect(b).withColumn("part", F.lit("both"))
            .union(a.except_(b).withColumn("part", F.lit("first only")))
            .union(a.union(b).withColumn("part", F.lit("either"))))


@query("approx_vs_exact", user_sql("""
SELECT country, count(DISTINCT user_id) AS user_count_exact, TRUE AS approx_is_close FROM ua
WHERE session_day IS NOT NULL GROUP BY country"""))
def approx_vs_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buyers per country. Distinct first, then sketch and count side by side."""
    ua = demo_frames(spark, sf_dir).user_aggregates(daily=False, total=False)
    buyers = ua.where(F.col("session_day").isNotNull()).select("country", "user_id").distinct()
    counts = buyers.groupBy("country").agg(F.count(F.lit(1)).alias("user_count_exact"),
                                           F.approx_count_distinct("user_id", 0.02).alias("approx"))
    close = F.abs(F.col("approx") - F.col("user_count_exact")) <= F.ceil(F.col("user_count_exact") * 0.1)
    return counts.select("country", "user_count_exact", close.alias("approx_is_close"))
