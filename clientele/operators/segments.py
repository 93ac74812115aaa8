"""Segments: which users satisfy a set of conditions, and how many are they.

Rows of `user_aggregates` are one user on one day. In `row` scope (the default)
all conditions must hold on the same row, so sums run over one day and a
'not bought' holds for a user as soon as one row satisfies it. In `user` scope
the rows of a user are summed up first and the conditions apply to the user.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from clientele.functions.dates import day_of, within
from clientele.functions.nested import bought, items_bought
from clientele.operators.users import DAILY_ARRAY, TOTAL_ARRAY

DAY = "session_day"


@dataclass(frozen=True)
class Condition:
    row: Column         # boolean, on one row
    per_user: Column    # boolean aggregate, over the rows of a user


def _any(test: Column) -> Column:
    return F.coalesce(F.bool_or(test), F.lit(False))


@dataclass(frozen=True)
class Segment:
    """Immutable builder; every call adds one condition.

    >>> young = segment(ua).where_attr(F.col("age") < 35).bought("Brand#4", min_items=2)
    >>> young.count()
    """
    rows: DataFrame
    conditions: tuple[Condition, ...] = ()
    scope: str = "row"

    def _with(self, row: Column, per_user: Column) -> "Segment":
        return replace(self, conditions=(*self.conditions, Condition(row, per_user)))

    def per_user(self) -> "Segment":
        return replace(self, scope="user")

    def where_attr(self, test: Column) -> "Segment":
        """A condition on columns that are the same on all rows of a user."""
        return self._with(test, _any(test))

    def bought(self, brand: str, *, min_items: int | None = None, since: Column | None = None,
               until: Column | None = None, weight: Column | None = None) -> "Segment":
        """Bought the brand in the range of days; at least so many items if asked."""
        day = day_of(F.col(DAY))
        if min_items is None:
            test = bought(DAILY_ARRAY, brand, day, since=since, until=until)
            return self._with(test, _any(test))
        items = items_bought(DAILY_ARRAY, brand)
        if weight is not None:
            items = items * weight
        span = within(day, since, until)
        return self._with(span & (items >= min_items), F.sum(F.when(span, items)) >= min_items)

    def bought_before(self, brand: str, day: Column) -> "Segment":
        """Bought the brand strictly before a day."""
        test = bought(DAILY_ARRAY, brand) & (day_of(F.col(DAY)) < day)
        return self._with(test, _any(test))

    def bought_ever(self, brand: str, *, over_items: int | None = None, over_spend: float | None = None) -> "Segment":
        """Bought the brand at any time; strictly more than the bounds if given."""
        test = bought(TOTAL_ARRAY, brand, min_items=over_items, min_spend=over_spend)
        return self._with(test, _any(test))

    def not_bought(self, brand: str, *, since: Column | None = None, until: Column | None = None,
                   after: Column | None = None) -> "Segment":
        """Did not buy the brand in the range of days / strictly after a day."""
        day = day_of(F.col(DAY))
        hit = bought(DAILY_ARRAY, brand, day, since=since, until=until)
        if after is not None:
            hit = hit & (day > after)
        return self._with(~F.coalesce(hit, F.lit(False)), ~_any(hit))

    def spent(self, at_least: float, *, since: Column | None = None, until: Column | None = None,
              weight: Column | None = None) -> "Segment":
        """Spent so much in the range of days.

        In row scope the money of the day counts once per brand bought that day,
        which is what summing it over the unnested brand array amounts to."""
        span = within(day_of(F.col(DAY)), since, until)
        per_row = F.col("daily_spend") * F.size(DAILY_ARRAY)
        if weight is not None:
            per_row = per_row * weight
        return self._with(span & (per_row >= at_least), F.sum(F.when(span, F.col("daily_spend"))) >= at_least)

    def bought_one_of(self, top: DataFrame, *, at_least: int = 1, since: Column | None = None,
                      until: Column | None = None) -> DataFrame:
        """Users of the segment that bought one (or several) of the products in
        `top` (one column, product_id) in the range of days. Returns user ids. In user
        scope all rows of the users of the segment count, else the matching rows."""
        rows = self._matching_rows() if self.scope == "row" else self.rows.join(self.users(), "user_id", "left_semi")
        rows = rows.where(within(day_of(F.col(DAY)), since, until))
        ids = (rows.select("user_id", F.explode(DAILY_ARRAY).alias("b"))
               .select("user_id", F.explode("b.product_ids").alias("product_id"))
               .join(top.select("product_id"), "product_id", "left_semi"))
        if at_least == 1:
            return ids.select("user_id").distinct()
        pairs = ids.distinct()      # partial aggregation first: no user is gathered whole
        return (pairs.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
                .where(F.col("n") >= at_least).select("user_id"))

    def _matching_rows(self) -> DataFrame:
        rows = self.rows
        for condition in self.conditions:
            rows = rows.where(condition.row)
        return rows

    def users(self) -> DataFrame:
        """The distinct user ids."""
        if self.scope == "row":
            return self._matching_rows().select("user_id").distinct()
        flags = [c.per_user.alias(f"_c{i}") for i, c in enumerate(self.conditions)]
        out = self.rows.groupBy("user_id").agg(*flags)
        for i in range(len(flags)):
            out = out.where(F.col(f"_c{i}"))
        return out.select("user_id")

    def count(self, approx: bool = True, rsd: float = 0.05) -> DataFrame:
        """One row, user_count; approximate unless asked otherwise. The
        approximate count needs no distinct step: sketches merge map-side."""
        if not approx:
            return self.users().agg(F.count(F.lit(1)).alias("user_count"))
        ids = self._matching_rows() if self.scope == "row" else self.users()
        return ids.agg(F.approx_count_distinct("user_id", rsd).alias("user_count"))

    # Segment algebra on user ids.
    def intersect(self, other: "Segment") -> DataFrame:
        return self.users().intersect(other.users())

    def union(self, other: "Segment") -> DataFrame:
        return self.users().union(other.users()).distinct()

    def except_(self, other: "Segment") -> DataFrame:
        return self.users().join(other.users(), "user_id", "left_anti")


def segment(user_aggregates: DataFrame) -> Segment:
    return Segment(user_aggregates)


def count_both(ids: DataFrame, rsd: float = 0.05) -> DataFrame:
    """Exact and approximate count of a frame of user ids in one pass.

    The ids are made distinct first, so the sketch sits next to a plain count
    instead of one sketch per user."""
    return ids.distinct().agg(F.count(F.lit(1)).alias("user_count_exact"),
                              F.approx_count_distinct("user_id", rsd).alias("user_count"))
