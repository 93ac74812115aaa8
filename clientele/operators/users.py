"""User aggregates: per day, over the whole life, and both joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clientele.functions.dates import day_start
from clientele.functions.money import as_money
from clientele.functions.text import distinct_list
from clientele.operators.sessions import abandoned_carts
from clientele.schemas import DAY_BRAND, LIFE_BRAND, USER_AGGREGATES

DAILY_ARRAY = "daily_purchased_products_by_brands"
TOTAL_ARRAY = "total_purchased_products_by_brands"


def brand_base(lines: DataFrame) -> DataFrame:
    """Purchases summed up per user, session start, brand and product.

    Shared first step of the daily and the lifetime columns: repeats collapse on
    the map side, and because both sides read exactly these columns Spark runs
    the step, including its shuffle, once."""
    return (lines.groupBy("user_id", "session_created_at", "brand_name", "product_id", "category")
            .agg(F.count(F.lit(1)).alias("items"), F.sum("item_price").alias("spend")))


def _brand_columns() -> list[Column]:
    return [distinct_list(F.col("category")).alias("category"),
            F.sort_array(F.collect_set("product_id")).alias("product_ids"),
            F.sum("items").alias("purchased_items"),
            as_money(F.sum("spend")).alias("brand_spend"),
            F.sum("spend").alias("_spend")]


def user_day_brand(lines: DataFrame) -> DataFrame:
    """What a user bought of a brand on one day.

    The base is distributed by user and day once; grouping by brand here and by
    day in `day_arrays` then happens inside these partitions. A heavy user is
    still spread over the days."""
    base = brand_base(lines).withColumn("session_day", day_start(F.col("session_created_at")))
    return (base.repartition("user_id", "session_day")
            .groupBy("user_id", "session_day", "brand_name").agg(*_brand_columns()))


def user_brand_global(lines: DataFrame) -> DataFrame:
    """What a user ever bought of a brand, and when first and last."""
    return brand_base(lines).groupBy("user_id", "brand_name").agg(
        *_brand_columns(), F.min("session_created_at").alias("_first"), F.max("session_created_at").alias("_last"))


def user_day_orders(lines: DataFrame) -> DataFrame:
    """Items and money per user and day."""
    return (lines.groupBy("user_id", "session_day")
            .agg(F.count("item_cost").alias("daily_purchased_items"),
                 as_money(F.sum("item_price")).alias("daily_spend")))


def user_orders_global(lines: DataFrame) -> DataFrame:
    """Items, money, first and last purchase per user."""
    return (lines.groupBy("user_id")
            .agg(F.count("item_cost").alias("total_purchased_items"),
                 as_money(F.sum("item_price")).alias("total_spend"),
                 F.min("session_created_at").alias("first_purchase_date"),
                 F.max("session_created_at").alias("last_purchase_date")))


def _nest(fields: list[str]) -> Column:
    return F.sort_array(F.collect_list(F.struct(*fields)))


def day_arrays(lines: DataFrame) -> DataFrame:
    """Per user and day: items, money and the array of brand structs."""
    return (user_day_brand(lines).groupBy("user_id", "session_day")
            .agg(F.sum("purchased_items").alias("daily_purchased_items"),
                 as_money(F.sum("_spend")).alias("daily_spend"),
                 _nest(DAY_BRAND.fieldNames()).alias(DAILY_ARRAY)))


def life_arrays(lines: DataFrame) -> DataFrame:
    """`user_orders_global` plus the array of lifetime brand structs."""
    return (user_brand_global(lines).groupBy("user_id")
            .agg(F.sum("purchased_items").alias("total_purchased_items"),
                 as_money(F.sum("_spend")).alias("total_spend"),
                 F.min("_first").alias("first_purchase_date"), F.max("_last").alias("last_purchase_date"),
                 _nest(LIFE_BRAND.fieldNames()).alias(TOTAL_ARRAY)))


# A user with more purchase lines than this gets more than one task.
HEAVY_LINES = 1_000_000
HEAVY_USERS, TRACKED = 1000, 100_000         # bounds of the sketch that looks for them


def heavy_users(lines: DataFrame, most: int | None = None) -> list:
    """Users with more than `most` lines, by a frequent-items sketch: one pass that shuffles
    sketches only. At most HEAVY_USERS of them are named; a user that is missed costs time,
    not rows."""
    top = lines.where(F.col("user_id").isNotNull()).agg(
        F.expr(f"approx_top_k(user_id, {HEAVY_USERS}, {TRACKED})").alias("top")).first()["top"]
    return sorted(t["item"] for t in top or [] if t["count"] > (HEAVY_LINES if most is None else most))


def brand_cells(by_user: DataFrame) -> DataFrame:
    """Per user, day and brand, with what the coarser levels need."""
    return by_user.groupBy("user_id", "session_day", "brand_name").agg(
        F.collect_set("category").alias("_categories"), F.collect_set("product_id").alias("_ids"),
        F.count(F.lit(1)).alias("purchased_items"), F.sum("item_price").alias("_spend"),
        F.min("session_created_at").alias("_first"), F.max("session_created_at").alias("_last"))


def _shown(categories: Column, ids: Column) -> list[Column]:
    return [F.when(F.size(categories) > 0, F.array_join(F.sort_array(categories), ",")).alias("category"),
            F.sort_array(ids).alias("product_ids"), as_money(F.col("_spend")).alias("brand_spend")]


def cell_days(cells: DataFrame) -> DataFrame:
    """`day_arrays` from brand cells."""
    # always true: days then read what the lifetime reads, so that Spark shares the exchange below both
    cells = cells.where(F.col("_last").isNull() | (F.col("_first") <= F.col("_last")))
    return cells.select("*", *_shown(F.col("_categories"), F.col("_ids"))).groupBy("user_id", "session_day").agg(
        F.sum("purchased_items").alias("daily_purchased_items"), as_money(F.sum("_spend")).alias("daily_spend"),
        _nest(DAY_BRAND.fieldNames()).alias(DAILY_ARRAY))


def cell_life(cells: DataFrame) -> DataFrame:
    """`life_arrays` from brand cells."""
    brands = cells.groupBy("user_id", "brand_name").agg(
        F.array_distinct(F.flatten(F.collect_list("_categories"))).alias("_categories"),
        F.array_distinct(F.flatten(F.collect_list("_ids"))).alias("_ids"), F.sum("purchased_items").alias("purchased_items"),
        F.sum("_spend").alias("_spend"), F.min("_first").alias("_first"), F.max("_last").alias("_last"))
    return brands.select("*", *_shown(F.col("_categories"), F.col("_ids"))).groupBy("user_id").agg(
        F.sum("purchased_items").alias("total_purchased_items"), as_money(F.sum("_spend")).alias("total_spend"),
        F.min("_first").alias("first_purchase_date"), F.max("_last").alias("last_purchase_date"),
        _nest(LIFE_BRAND.fieldNames()).alias(TOTAL_ARRAY))


def user_history(lines: DataFrame, heavy: list | tuple = ()) -> tuple[DataFrame, DataFrame]:
    """`day_arrays` and `life_arrays` from one distribution of the lines.

    The lines are hashed by user once; every level - day and brand, day, brand, lifetime -
    groups within these partitions, and a join of both results by user moves nothing
    either. All lines of a user meet in one task. For users named in `heavy` they do not:
    theirs are pre-aggregated and distributed by user and day."""
    many = F.col("user_id").isin(list(heavy))
    cells = brand_cells((lines.where(F.col("user_id").isNull() | ~many) if heavy else lines).repartition("user_id"))
    days, life = cell_days(cells), cell_life(cells)
    if heavy:
        theirs = lines.where(many)
        days, life = days.unionByName(day_arrays(theirs)), life.unionByName(life_arrays(theirs))
    return days, life


def user_daily(users: DataFrame, lines: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """Every user with their purchase days; one row with NULLs if there is none. `days`: rows
    of days that were made already."""
    days = (day_arrays(lines) if days is None else days).withColumnRenamed("user_id", "id")
    return users.select("id").join(days, "id", "left").select(
        "id", "session_day", "daily_purchased_items", "daily_spend", DAILY_ARRAY)


def cart_flags(marks: DataFrame, include_never_purchased: bool = False) -> DataFrame:
    """(user_id, has_abandoned_cart) for everybody with a cart or a purchase.

    Some cart is later than the last purchase exactly if the latest cart is, so
    the flag needs no join, only one small row per user and task."""
    at = F.col("session_created_at")
    latest = marks.groupBy("user_id").agg(F.max(F.when(F.col("has_cart"), at)).alias("_cart"),
                                          F.max(F.when(F.col("has_purchase"), at)).alias("_purchase"))
    flag = F.coalesce(F.col("_cart") > F.col("_purchase"), F.lit(False))
    if include_never_purchased:
        flag = flag | (F.col("_cart").isNotNull() & F.col("_purchase").isNull())
    return latest.select("user_id", flag.alias("has_abandoned_cart"))


def cart_copies(marks: DataFrame, include_never_purchased: bool = False) -> DataFrame:
    """How many abandoned sessions a user has (no row for none)."""
    return (abandoned_carts(marks, include_never_purchased).groupBy("user_id")
            .agg(F.count(F.lit(1)).alias("copies")))


def user_global(users: DataFrame, lines: DataFrame, marks: DataFrame, *, dedupe_carts: bool = True,
                include_never_purchased: bool = False, arrays: bool = True, life: DataFrame | None = None) -> DataFrame:
    """One row per user: who they are and what they did so far. `life`: lifetime rows with
    arrays that were made already.

    With `dedupe_carts=False` a user comes back once per abandoned session, the
    way a plain left join to those sessions would do it."""
    if life is None:
        life = life_arrays(lines) if arrays else user_orders_global(lines)
    out = (users.select("id", "age", "gender", "country")
           .join(life.withColumnRenamed("user_id", "id"), "id", "left")
           .join(cart_flags(marks, include_never_purchased).withColumnRenamed("user_id", "id"), "id", "left"))
    if not dedupe_carts:
        carts = abandoned_carts(marks, include_never_purchased).select(F.col("user_id").alias("id"))
        out = out.join(carts, "id", "left")
    return out.select("id", "age", "gender", "country", "total_purchased_items", "total_spend", "first_purchase_date",
                      "last_purchase_date", *([TOTAL_ARRAY] if arrays else []),
                      F.coalesce("has_abandoned_cart", F.lit(False)).alias("has_abandoned_cart"))


def _empty(kind) -> Column:
    return F.array().cast(kind)


def user_aggregates(global_: DataFrame, daily: DataFrame, how: str = "inner") -> DataFrame:
    """Lifetime columns repeated on every day row, in the order of the schema.

    `user_daily` has a row for every user; with a frame of bare purchase days
    join "left" for the same result. Missing arrays become empty ones. Either array may be left out of the inputs
    when a question does not read it; it is then missing in the result too."""
    joined = global_.join(daily, "id", how).withColumnRenamed("id", "user_id")
    out = []
    for field in USER_AGGREGATES.fields:
        if field.name in joined.columns:
            value = F.col(field.name)
            if field.name in (DAILY_ARRAY, TOTAL_ARRAY):
                value = F.coalesce(value, _empty(field.dataType))
            out.append(value.alias(field.name))
    return joined.select(*out)


def with_copies(aggregates: DataFrame, marks: DataFrame) -> DataFrame:
    """Adds `copies`: how often the un-deduplicated join repeats both arrays.

    Summing over a repeated array equals multiplying the sum, so the repetition
    is carried as a number and never written out."""
    copies = cart_copies(marks)
    return (aggregates.join(copies, "user_id", "left")
            .withColumn("copies", F.coalesce("copies", F.lit(1)).cast("long")))


def repeat_arrays(with_copies_: DataFrame) -> DataFrame:
    """Writes the repetition out, for consumers that want the literal rows."""
    out = with_copies_
    for name in (DAILY_ARRAY, TOTAL_ARRAY):
        out = out.withColumn(name, F.flatten(F.array_repeat(F.col(name), F.col("copies").cast("int"))))
    return out.drop("copies")


def conforms(aggregates: DataFrame) -> DataFrame:
    """Types and comments of the final schema (for the stored table)."""
    return aggregates.select(*[F.col(f.name).cast(f.dataType).alias(f.name, metadata=f.metadata)
                               for f in USER_AGGREGATES.fields])


