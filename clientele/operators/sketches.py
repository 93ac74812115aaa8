"""User counts from stored theta sketches: segments without reading a user row.

A sketch holds the users of a cell - a brand on a day, a day with a spend, a brand over the
life, a group of people. Sketches are united over cells, intersected and subtracted, so a
question opens the cells it names, however many users they have. Up to 2^LG users a result
is exact; beyond that its standard error is about 2^(-LG/2), and after an intersection or a
difference that share of the union of both sides.

The tables by day are partitioned like the day tables, so a new day adds its own cells.
Conditions mean what `segments` means by them in row scope; bounds have to be on the ladders
below, because cells are cut there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clientele.functions.dates import day_of, within
from clientele.operators.users import DAILY_ARRAY, TOTAL_ARRAY
from clientele.sources import tables

LG = 14
ITEMS = 10                                   # so many items and more share a cell
SPENDS = (0, 50, 100, 1000, 10_000)          # ladder of "at least" and of "more than"
DAY, PARTITION = "session_day", "session_date"
BY_DAY = ("days", "brand_days")
KEYS = {"days": [DAY, "level"], "brand_days": ["brand_name", DAY, "level"], "brands": ["brand_name", "level"],
        "people": ["age", "gender", "country"]}


def _level(value: Column, strict: bool) -> Column:
    return sum(((value > s if strict else value >= s).cast("int") for s in SPENDS), F.lit(0))


def _step(bound: float) -> int:
    if bound not in SPENDS:
        raise ValueError(f"{bound} is not one of {SPENDS}, where the cells are cut")
    return SPENDS.index(bound) + 1


def _sketch(rows: DataFrame, keys: list[str], lg: int) -> DataFrame:
    return rows.where(F.col("user_id").isNotNull()).groupBy(*keys).agg(F.call_function("theta_sketch_agg", F.col("user_id"), F.lit(lg)).alias("users"))


def cells(user_aggregates: DataFrame, lg: int = LG) -> dict[str, DataFrame]:
    """The four tables of sketches. Rows of user_aggregates may come in any order and more
    than once; users without a purchase day are in `people` only. Sketches merge on the
    map side, so a cell that holds most users is no hot key."""
    bought = user_aggregates.where(F.col(DAY).isNotNull())
    # the money of a day counts once per brand of the day, as in `segments.spent`
    spent = F.col("daily_spend") * F.size(DAILY_ARRAY)
    by_brand = bought.select("user_id", DAY, F.explode(DAILY_ARRAY).alias("b")).select(
        "user_id", DAY, "b.brand_name", F.least("b.purchased_items", F.lit(ITEMS)).alias("level"))
    ever = user_aggregates.select("user_id", F.explode(TOTAL_ARRAY).alias("b")).select(
        "user_id", "b.brand_name", _level(F.coalesce("b.brand_spend", F.lit(-1.0)), True).alias("level"))
    rows = {"days": bought.select("user_id", DAY, _level(F.coalesce(spent, F.lit(-1.0)), False).alias("level")),
            "brand_days": by_brand, "brands": ever, "people": user_aggregates.select("user_id", "age", "gender", "country")}
    return {name: _sketch(part, KEYS[name], lg) for name, part in rows.items()}


def store(user_aggregates: DataFrame, path: str, period, lg: int = LG) -> "Sketches":
    """Write all cells below `path`; `period` gives the partition of a day column."""
    made = {}
    for name, df in cells(user_aggregates, lg).items():
        rows = df.withColumn(PARTITION, period(F.col(DAY))) if name in BY_DAY else df
        tables.write_table(rows, f"{path}/{name}", PARTITION if name in BY_DAY else None)
        made[name] = tables.read_table(user_aggregates.sparkSession, f"{path}/{name}", rows.schema)
    return Sketches(**made, lg=lg)


def add_days(user_aggregates: DataFrame, path: str, period, lg: int = LG) -> None:
    """Replace the cells of the days found in these rows, and add their users to the
    others. Running it twice changes nothing."""
    spark = user_aggregates.sparkSession
    for name, df in cells(user_aggregates, lg).items():
        if name in BY_DAY:
            tables.replace_days(df.withColumn(PARTITION, period(F.col(DAY))), f"{path}/{name}", PARTITION, DAY)
        else:
            # lifetime levels only rise with new purchases, so a user may stand on two of
            # them; `bought_ever` asks for a level and all above it
            kept = spark.read.parquet(f"{path}/{name}")
            both = kept.unionByName(df).groupBy(*KEYS[name]).agg(
                F.call_function("theta_union_agg", F.col("users"), F.lit(lg)).alias("users"))
            tables.swap_table(both, f"{path}/{name}")


def read(spark: SparkSession, path: str, lg: int = LG) -> "Sketches":
    return Sketches(*[tables.read_table(spark, f"{path}/{name}") for name in KEYS], lg=lg)


@dataclass(frozen=True)
class Sketches:
    days: DataFrame
    brand_days: DataFrame
    brands: DataFrame
    people: DataFrame
    lg: int = LG

    def _union(self, cells: DataFrame, column: str = "users") -> Column:
        return cells.agg(F.call_function("theta_union_agg", F.col(column), F.lit(self.lg))).scalar()

    def _of_brand(self, brand: str, since: Column | None, until: Column | None) -> DataFrame:
        return self.brand_days.where((F.col("brand_name") == brand) & within(day_of(F.col(DAY)), since, until))

    def where_attr(self, test: Column) -> Column:
        """Users by age, gender and country."""
        return self._union(self.people.where(test))

    def bought(self, brand: str, *, min_items: int = 1, since: Column | None = None, until: Column | None = None) -> Column:
        if min_items > ITEMS:
            raise ValueError(f"at most {ITEMS} items are told apart")
        return self._union(self._of_brand(brand, since, until).where(F.col("level") >= min_items))

    def bought_ever(self, brand: str, over_spend: float | None = None) -> Column:
        at = 0 if over_spend is None else _step(over_spend)
        return self._union(self.brands.where((F.col("brand_name") == brand) & (F.col("level") >= at)))

    def spent(self, at_least: float, *, since: Column | None = None, until: Column | None = None) -> Column:
        return self._union(self.days.where(within(day_of(F.col(DAY)), since, until) & (F.col("level") >= _step(at_least))))

    def not_bought(self, brand: str, *, since: Column | None = None, until: Column | None = None) -> Column:
        """Users with some purchase day that is no purchase of the brand in the range: per
        day its buyers without those of the brand, then over all days."""
        hits = self._of_brand(brand, since, until).groupBy(DAY).agg(F.call_function("theta_union_agg", F.col("users"), F.lit(self.lg)).alias("_hits"))
        all_ = self.days.groupBy(DAY).agg(F.call_function("theta_union_agg", F.col("users"), F.lit(self.lg)).alias("_all"))
        rest = F.when(F.col("_hits").isNull(), F.col("_all")).otherwise(F.call_function("theta_difference", F.col("_all"), F.col("_hits")))
        return self._union(all_.join(hits, DAY, "left").select(rest.alias("users")))


def both(a: Column, b: Column) -> Column:
    return F.call_function("theta_intersection", a, b)


def either(a: Column, b: Column, lg: int = LG) -> Column:
    return F.call_function("theta_union", a, b, F.lit(lg))


def without(a: Column, b: Column) -> Column:
    return F.call_function("theta_difference", a, b)


def counts(spark: SparkSession, **sets: Column) -> DataFrame:
    """One row with the number of users of each set."""
    return spark.range(1).select(*[F.call_function("theta_sketch_estimate", s).cast("long").alias(name) for name, s in sets.items()])
