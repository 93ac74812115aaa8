"""Days, date windows and random instants."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

DateLike = str | dt.date | Column | None


def day_of(ts: Column) -> Column:
    return F.to_date(ts)


def day_start(ts: Column) -> Column:
    """Midnight of the day. `date_trunc` would answer with a zoned timestamp
    even for a zone-less input; going through DATE keeps it zone-less."""
    return F.to_date(ts).cast("timestamp_ntz")


def as_date(value: DateLike) -> Column:
    """A DATE from a literal, a column or None (= today)."""
    if value is None:
        return F.current_date()
    if isinstance(value, Column):
        return value.cast("date")
    return F.lit(str(value)).cast("date")


def months_before(day: DateLike, months: int) -> Column:
    """Same day some months earlier, clamped to the end of a short month."""
    return F.add_months(as_date(day), -months)


def days_before(day: DateLike, days: int) -> Column:
    return F.date_sub(as_date(day), days)


def within(day: Column, since: Column | None = None, until: Column | None = None) -> Column:
    """`since <= day <= until`, either side optional."""
    test = F.lit(True)
    if since is not None:
        test = test & (day >= since)
    if until is not None:
        test = test & (day <= until)
    return test


def rand_date(earliest: DateLike, latest: DateLike, seed: int) -> Column:
    """A uniformly random instant between two dates, as TIMESTAMP."""
    low = F.unix_seconds(as_date(earliest).cast("timestamp"))
    high = F.unix_seconds(as_date(latest).cast("timestamp"))
    return F.timestamp_seconds(F.round(low + F.rand(seed) * (high - low)).cast("long"))


def utc_timestamp(ts: Column) -> Column:
    """A zone-less timestamp read as UTC, whatever the session zone is."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), ts).cast("timestamp")


def utc_ntz(ts: Column) -> Column:
    """The inverse: the UTC wall clock of a zoned timestamp."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts.cast("timestamp_ntz"))
