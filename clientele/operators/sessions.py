"""Sessions: pricing, nesting, unnesting, purchases and abandoned carts.

Two equivalent inputs feed the user and product aggregates:

* the stored `events` table (one row per session, events nested), read with
  `unnest_session`, `purchase_lines` and `marks_of_sessions` - narrow, no shuffle;
* the flat click stream, read with `price_events`, `purchase_lines_flat` and
  `session_marks` - nothing is gathered into an array and no total per session
  is needed, so a session of any length is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clientele.functions.dates import day_start
from clientele.functions.money import as_money, numeric
from clientele.functions.nested import has_event
from clientele.functions.text import squash

SESSION_KEYS = ["user_id", "country", "session_id", "session_created_at", "traffic_source"]
# A session has one user and one start; these identify it and are never NULL.
FACT_KEYS = ["user_id", "session_id", "session_created_at"]
# The two event types that carry meaning here.
CART, PURCHASE = "cart", "purchase"
# Product id of the events that concern no product.
NO_PRODUCT = 0
EVENT_FIELDS = ["event_type", "product_id", "created_at", "sequence_number", "uri", "cost", "category", "name",
                "brand", "department"]


def event_uri() -> Column:
    """Address of a department or product page; NULL for any other event."""
    department = F.concat(
        F.lit("/department/"), squash(F.col("department")), F.lit("/category/"), squash(F.col("category")),
        F.lit("/brand/"), squash(F.col("brand")))
    product = F.concat(F.lit("/product/"), F.col("product_id").cast("string"))
    return (F.when(F.col("event_type") == "department", department)
             .when(F.col("event_type") == "product", product))


def price_events(raw: DataFrame, products: DataFrame) -> DataFrame:
    """Look up the product of every event; events without one keep NULLs.

    Events without a product pass beside the join, so their one id is no hot key.
    No broadcast hint: Spark broadcasts the products only if their measured size is
    below its threshold. Once a later step asks for priced rows only, Catalyst drops
    the events without a product before any shuffle."""
    looked_up = products.where(F.col("id") != NO_PRODUCT).select(
        F.col("id").alias("_id"), "cost", numeric(F.col("cost")).alias("price"), "category", "name", "brand",
        "department")
    has_product = F.coalesce(F.col("product_id") != NO_PRODUCT, F.lit(False))
    about = raw.where(has_product).join(looked_up, F.col("product_id") == F.col("_id"), "left").drop("_id")
    found = [f for f in looked_up.schema.fields if f.name != "_id"]
    other = raw.where(~has_product).withColumns({f.name: F.lit(None).cast(f.dataType) for f in found})
    return about.unionByName(other).withColumn("uri", event_uri())


def _total(seen: Column, bought: Column) -> Column:
    return F.when(bought, as_money(seen)).otherwise(F.lit(0.0))


def session_totals(priced: DataFrame) -> DataFrame:
    """Per session: total_cost, the two flags and the number of events.

    total_cost is the price of everything looked at if the session ended in a
    purchase (NULL if nothing had a price), and 0 if it did not."""
    sums = priced.groupBy(*FACT_KEYS).agg(
        F.sum("price").alias("_seen"),
        F.max(F.col("event_type") == PURCHASE).alias("has_purchase"),
        F.max(F.col("event_type") == CART).alias("has_cart"),
        F.count(F.lit(1)).alias("n_events"))
    total = _total(F.col("_seen"), F.col("has_purchase"))
    return sums.select(*FACT_KEYS, total.alias("total_cost"), "has_purchase", "has_cart", "n_events")


def nest_sessions(priced: DataFrame, gathered: bool = False) -> DataFrame:
    """The `events` table: one row per session, its events as an ordered array and its
    total, from a single grouping.

    Events move as plain rows, once; before that, gathering them into arrays would only
    make them larger. What follows from other columns is made afterwards. `gathered`: the
    events of a session are in one partition already, by a join on it."""
    rows = priced.select(*SESSION_KEYS, *[c for c in EVENT_FIELDS if c != "uri"])
    rows = rows if gathered else rows.repartition(*SESSION_KEYS)
    priced = rows.withColumns({"uri": event_uri(), "price": numeric(F.col("cost"))})
    # sorted by sequence_number; `_events.e` then takes the events out again
    numbered = F.struct("sequence_number", F.struct(*EVENT_FIELDS).alias("e"))
    return (priced.groupBy(*SESSION_KEYS)
            .agg(F.sum("price").alias("_seen"), F.max(F.col("event_type") == PURCHASE).alias("_bought"),
                 F.sort_array(F.collect_list(numbered)).alias("_events"))
            .select("user_id", "country", "session_id", "traffic_source", "session_created_at",
                    _total(F.col("_seen"), F.col("_bought")).alias("total_cost"), F.col("_events.e").alias("session")))


def build_events(raw: DataFrame, products: DataFrame) -> DataFrame:
    """Flat click stream + products -> `events` (one row per session)."""
    return nest_sessions(price_events(raw, products))


def unnest_session(events: DataFrame) -> DataFrame:
    """One row per event again; sessions without events vanish."""
    parents = [c for c in events.columns if c != "session"]
    return events.select(*parents, F.explode("session").alias("_e")).select(*parents, "_e.*")


def _as_lines(rows: DataFrame) -> DataFrame:
    price = F.col("price") if "price" in rows.columns else numeric(F.col("cost"))
    return rows.select(
        "user_id", "session_created_at",
        day_start(F.col("session_created_at")).alias("session_day"),
        F.col("cost").alias("item_cost"), price.alias("item_price"),
        F.col("brand").alias("brand_name"), "product_id", "category")


def purchase_lines(events: DataFrame) -> DataFrame:
    """Priced items of the sessions that were paid for, from stored `events`."""
    return _as_lines(unnest_session(events.where(F.col("total_cost") > 0)).where(F.col("cost") > 0))


def paid_sessions(raw: DataFrame, priced: DataFrame | None = None) -> DataFrame:
    """Keys of the sessions with a purchase and a positive total, possibly repeated;
    for semi joins with priced events only.

    Next to an event with a price above 0 the total is above 0 as well, so the
    purchase events alone decide - unless some product costs less than nothing.
    Pass the priced events in that case: the totals of the sessions with such a
    product are then worked out."""
    bought = raw.where(F.col("event_type") == PURCHASE).select(*FACT_KEYS)
    if priced is None:
        return bought
    below = priced.where(F.col("cost") < 0).select(*FACT_KEYS).distinct()
    sums = priced.join(below, FACT_KEYS, "left_semi").groupBy(*FACT_KEYS).agg(F.sum("price").alias("_seen"))
    return bought.join(sums.where(F.col("_seen") <= 0), FACT_KEYS, "left_anti")


def purchase_lines_flat(priced: DataFrame, paid: DataFrame) -> DataFrame:
    """The same from the flat stream: keep the priced events of paid sessions.

    Joining on all keys of a session lets Catalyst carry a later filter on the
    day or the user over to the other side as well."""
    return _as_lines(priced.where(F.col("cost") > 0).join(paid, FACT_KEYS, "left_semi"))


def session_marks(raw: DataFrame) -> DataFrame:
    """The cart and purchase events of the flat stream; no grouping needed yet."""
    kind = F.col("event_type")
    return raw.where(kind.isin(CART, PURCHASE)).select(
        *FACT_KEYS, (kind == CART).alias("has_cart"), (kind == PURCHASE).alias("has_purchase"))


def marks_of_sessions(events: DataFrame) -> DataFrame:
    """The same from stored `events`, one row per stored row."""
    return events.select(*FACT_KEYS, has_event("session", CART).alias("has_cart"),
                         has_event("session", PURCHASE).alias("has_purchase"))


def sessions_with(marks: DataFrame, flag: str) -> DataFrame:
    """Latest instant of each session with a cart / a purchase."""
    return (marks.where(F.col(flag)).groupBy("user_id", "session_id")
            .agg(F.max("session_created_at").alias("session_created_at")))


def last_purchases(marks: DataFrame) -> DataFrame:
    return (marks.where("has_purchase").groupBy("user_id")
            .agg(F.max("session_created_at").alias("last_purchase_at")))


def abandoned_carts(marks: DataFrame, include_never_purchased: bool = False) -> DataFrame:
    """Sessions with a cart that are later than the user's last purchase.

    A user who never bought anything has no last purchase to compare with and
    is left out unless asked for."""
    carts = sessions_with(marks, "has_cart")
    if include_never_purchased:
        joined = carts.join(last_purchases(marks), "user_id", "left")
        later = F.col("last_purchase_at").isNull() | (F.col("session_created_at") > F.col("last_purchase_at"))
    else:
        joined = carts.join(last_purchases(marks), "user_id")
        later = F.col("session_created_at") > F.col("last_purchase_at")
    return joined.where(later).select("user_id", "session_id")

