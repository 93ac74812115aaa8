"""The dataset build: clicks, users and products to the aggregate tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clientele import schemas
from clientele.operators import products as prod, sessions as sess, users as usr
from clientele.sources import demo, tables


@dataclass(frozen=True)
class Frames:
    """The inputs of all aggregates, lazily defined."""
    users: DataFrame
    priced: DataFrame      # one row per event
    marks: DataFrame       # cart and purchase marks of the sessions
    lines: DataFrame       # one row per purchased item
    paid: DataFrame        # keys of the sessions that were paid for

    def user_aggregates(self, daily: bool = True, total: bool = True, heavy: list | tuple = ()) -> DataFrame:
        """With both arrays the lines are distributed once, but for those of `heavy` users. `daily` / `total` = False leaves that array (and its shuffles) out of
        the plan when a question does not read it. Days are joined to the user
        rows directly; going through `user_daily` would read the users twice."""
        if daily and total:
            days, life = usr.user_history(self.lines, heavy)
            out = usr.user_global(self.users, self.lines, self.marks, life=life)
            return usr.user_aggregates(out, days.withColumnRenamed("user_id", "id"), "left")
        days = usr.day_arrays(self.lines) if daily else usr.user_day_orders(self.lines)
        life = usr.user_global(self.users, self.lines, self.marks, arrays=total)
        return usr.user_aggregates(life, days.withColumnRenamed("user_id", "id"), "left")

    def product_aggregates(self) -> DataFrame:
        base = prod.product_base(self.priced)
        return prod.product_aggregates(prod.global_of(base), prod.daily_of(base))

    def product_daily(self) -> DataFrame:
        """The daily columns alone, for questions that do not ask for the lifetime."""
        return prod.product_daily(self.priced)


def from_clicks(users: DataFrame, products: DataFrame, raw: DataFrame, negative_prices: bool = False) -> Frames:
    """Frames over the flat click stream.

    Products that cost less than nothing (vouchers, refunds) need a total per session,
    which is a more expensive plan; say so with `negative_prices`. Without it a query
    that meets such a product fails with a message."""
    if not negative_prices:
        products = products.withColumn("cost", F.when(F.col("cost") < 0, F.raise_error(F.lit(
            "a product costs less than nothing: use negative_prices=True"))).otherwise(F.col("cost")))
    priced = sess.price_events(raw, products)
    paid = sess.paid_sessions(raw, priced if negative_prices else None)
    return Frames(users, priced, sess.session_marks(raw), sess.purchase_lines_flat(priced, paid), paid)


def from_events(users: DataFrame, events: DataFrame) -> Frames:
    """Frames over the stored `events` table; unnesting needs no shuffle."""
    paid = events.where(F.col("total_cost") > 0).select(*sess.FACT_KEYS)
    return Frames(users, sess.unnest_session(events), sess.marks_of_sessions(events), sess.purchase_lines(events), paid)


def demo_frames(spark: SparkSession, sf_dir: str, country: bool = False) -> Frames:
    """Frames over the provided tables; the product tables also need the country."""
    return from_clicks(demo.users(spark, sf_dir), demo.products(spark, sf_dir),
                       demo.session_events(spark, sf_dir, country))


def demo_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`build_events` over the provided tables: the same rows, priced before their sessions are joined."""
    products = demo.products(spark, sf_dir)
    return sess.nest_sessions(demo.looked_up_events(spark, sf_dir, lambda pages: sess.price_events(pages, products).drop("uri", "price")),
                              gathered=True)


PARTITION = "session_date"


def period_of(day: Column, grain: str = "DAY") -> Column:
    """First day of the period a row is stored under."""
    return F.trunc(F.to_date(day), grain) if grain != "DAY" else F.to_date(day)


def stored_days(table: DataFrame, since: Column, until: Column, grain: str = "DAY") -> DataFrame:
    """Rows of a range of days. The first test is on the partition column and
    decides which folders are opened, the second one picks the days in them."""
    opened = table.where(F.col(PARTITION).between(period_of(since, grain), until))
    return opened if grain == "DAY" else opened.where(F.to_date("session_day").between(since, until))


# Tables each table is made from.
NEEDS = {"events": (), "user_daily": ("events",), "user_global": ("events",), "user_aggregates": ("user_daily", "user_global"),
         "product_daily": ("events",), "product_global": ("events",), "product_aggregates": ("product_daily", "product_global")}


def build(spark: SparkSession, users: DataFrame, products: DataFrame, raw: DataFrame, out: str,
          grain: str = "DAY", wanted: list[str] | None = None, events: DataFrame | None = None) -> dict[str, DataFrame]:
    """Write the wanted tables (all by default) and those they are made from below
    `out`, and hand back readers for them.

    Each table is written once and read back by the next step: that cuts the
    lineage, survives lost executors and lets the later steps prune columns and
    days. Overwrites, so a second run leaves the same tables. `grain` DAY, MONTH
    or YEAR sets the size of a partition: days for large data, longer periods
    where a day would be a file of a few rows. `events`: nested sessions that are made already."""
    needed = set(wanted or NEEDS)
    while more := {n for name in needed for n in NEEDS[name]} - needed:
        needed |= more
    made: dict[str, DataFrame] = {}

    def store(name: str, df: Callable[[], DataFrame], day: str | None = None) -> None:
        if name in needed:
            rows = df()
            if day:
                rows = rows.withColumn(PARTITION, period_of(F.col(day), grain))
            tables.write_table(rows, f"{out}/{name}", PARTITION if day else None, comments=schemas.of_table(name), gather=grain != "YEAR")
            made[name] = tables.read_table(spark, f"{out}/{name}")

    store("events", lambda: sess.build_events(raw, products) if events is None else events, "session_created_at")
    base = from_events(users, made["events"].drop(PARTITION))
    heavy = usr.heavy_users(base.lines) if "user_daily" in needed or "user_global" in needed else ()
    days, life = usr.user_history(base.lines, heavy)
    store("user_daily", lambda: usr.user_daily(users, base.lines, days), "session_day")
    store("user_global", lambda: usr.user_global(users, base.lines, base.marks, life=life))
    store("user_aggregates", lambda: usr.conforms(usr.user_aggregates(
        made["user_global"], made["user_daily"].drop(PARTITION))), "session_day")
    store("product_daily", lambda: prod.product_daily(base.priced), "session_day")
    store("product_global", lambda: prod.product_global(base.priced))
    store("product_aggregates", lambda: prod.product_aggregates(
        made["product_global"], made["product_daily"].drop(PARTITION)), "session_day")
    return made
