"""Predicates and sums over the arrays of brand structs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from clientele.functions.dates import within


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def has_event(session: Column | str, event_type: str) -> Column:
    return F.array_contains(_col(session).getField("event_type"), event_type)


def bought(brands: Column | str, brand: str, day: Column | None = None, *, since: Column | None = None,
           until: Column | None = None, min_items: int | None = None, min_spend: float | None = None) -> Column:
    """Does the array hold the brand, on a row whose day lies in the range?

    The day test stays outside the array lambda, so it reaches the scan as an
    ordinary predicate (partition pruning). `min_items` and `min_spend` are
    strict lower bounds."""
    def match(entry: Column) -> Column:
        test = entry["brand_name"] == brand
        if min_items is not None:
            test = test & (entry["purchased_items"] > min_items)
        if min_spend is not None:
            test = test & (entry["brand_spend"] > min_spend)
        return test

    test = F.exists(_col(brands), match)
    return test if day is None else test & within(day, since, until)


def _sum_over(brands: Column | str, brand: str | None, field: str, kind: str) -> Column:
    entries = _col(brands)
    if brand is not None:
        entries = F.filter(entries, lambda e: e["brand_name"] == brand)
    zero = F.lit(0).cast(kind)
    return F.aggregate(entries, zero, lambda acc, e: acc + F.coalesce(e[field], zero))


def items_bought(brands: Column | str, brand: str | None = None) -> Column:
    """Items over the array, of one brand if named; 0 when nothing matches."""
    return _sum_over(brands, brand, "purchased_items", "bigint")


def spend_on(brands: Column | str, brand: str | None = None) -> Column:
    return _sum_over(brands, brand, "brand_spend", "double")


def number_range(count: Column) -> Column:
    """1..count as an array; empty (not [1, 0]) for 0."""
    return F.when(count >= 1, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))


def pick(options: list[str], index: Column) -> Column:
    """0-based choice out of a literal list, wrapping around."""
    return F.get(F.array(*[F.lit(o) for o in options]), F.pmod(index, F.lit(len(options))).cast("int"))
