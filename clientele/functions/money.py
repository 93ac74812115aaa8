"""Money and rounding."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Sums of prices run in fixed point: the result does not depend on the order in
# which tasks deliver their partial sums, so a retried task changes nothing.
NUMERIC = "decimal(38,9)"


def numeric(price: Column) -> Column:
    return price.cast(NUMERIC)


def numeric_sum(price: Column) -> Column:
    """Order-independent sum of prices, still fixed point."""
    return F.sum(numeric(price))


def as_money(total: Column) -> Column:
    return total.cast("double")


def round_half_away(value: Column) -> Column:
    """Nearest integer as BIGINT. A plain cast would cut 2.5 to 2."""
    return F.round(value).cast("long")


def rounded_seconds(seconds: Column, unset: float = -1) -> Column:
    """A stage duration for the report: three decimals, NULL when it never ran."""
    return F.when(seconds != F.lit(unset), F.round(seconds, 3))
