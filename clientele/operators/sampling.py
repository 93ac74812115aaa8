"""Row-number limits that do not sort the whole table in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

# Hex digits of the hash that name a bucket: 4 digits = 65,536 buckets at most.
_DIGITS = 4


def first_n_users(users: DataFrame, percent: float, id_col: str = "id") -> DataFrame:
    """The rows with `row number < percent * users / 100`: strictly less, so 100
    percent keeps all users but one.

    Which rows come first is free; here it is the order of the md5 of the id.
    md5 spreads ids evenly over its leading digits, so counting per bucket tells
    which buckets are in, which are out, and which single bucket is cut. Only
    the rows of the cut bucket are ever ranked."""
    hashed = users.withColumn("_h", F.md5(F.col(id_col).cast("string")))
    hashed = hashed.withColumn("_b", F.substring("_h", 1, _DIGITS))
    wanted = users.agg(F.countDistinct(id_col).alias("n")).select(
        (F.ceil(F.col("n") * F.lit(float(percent)) / 100) - 1).alias("_want"))
    # at most 65,536 rows from here on: one window over all of them is fine
    sizes = hashed.groupBy("_b").agg(F.count(F.lit(1)).alias("_size"))
    running = F.sum("_size").over(Window.partitionBy(F.lit(0)).orderBy("_b"))
    left = (sizes.withColumn("_before", running - F.col("_size"))
            .withColumn("_take", wanted.scalar() - F.col("_before"))
            .where(F.col("_take") > 0).select("_b", "_size", "_take"))
    kept = hashed.join(left, "_b")
    whole = kept.where(F.col("_take") >= F.col("_size"))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_h", id_col))
    cut = kept.where(F.col("_take") < F.col("_size")).withColumn("_r", rank).where(F.col("_r") <= F.col("_take"))
    return whole.select(*users.columns).unionByName(cut.select(*users.columns))


def random_n_of_top_m(totals: DataFrame, key: str, measure: str, n: int, m: int, seed: int = 0) -> DataFrame:
    """n keys at random out of the m largest. Repeatable: the order of the draw
    is the md5 of key and seed."""
    top = totals.orderBy(F.desc(measure), key).limit(m)
    draw = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))
    return top.orderBy(draw, key).limit(n)
