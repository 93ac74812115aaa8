"""Batch sessions out of raw events, for users of any activity.

A window over a user would sort all events of that user in one task. Instead the
events of a user are cut into time slots: inside a slot the previous event is
the row before, and the last event before a slot comes from a small table with
one row per user and slot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

SLOT = "HOUR"


def sessionize(events: DataFrame, gap_minutes: int = 30, user: str = "user_id", ts: str = "ts", slot: str = SLOT) -> DataFrame:
    """Adds `session_no` (1, 2, ... per user); a pause longer than the gap starts
    a new session. The slot sets how finely a busy user is spread."""
    gap = F.expr(f"INTERVAL {gap_minutes} MINUTES")
    rows = events.withColumn("_slot", F.date_trunc(slot, F.col(ts)).cast("timestamp_ntz"))
    slots = rows.groupBy(user, "_slot").agg(F.max(ts).alias("_last"))
    by_user = Window.partitionBy(user).orderBy("_slot")
    before = slots.select(user, "_slot", F.lag("_last").over(by_user).alias("_before"))
    in_slot = Window.partitionBy(user, "_slot").orderBy(ts)
    marked = (rows.join(before, [user, "_slot"])
              .withColumn("_prev", F.coalesce(F.lag(ts).over(in_slot), F.col("_before")))
              .withColumn("_new", (F.col("_prev").isNull() | (F.col(ts) > F.col("_prev") + gap)).cast("long"))
              .withColumn("_nth", F.sum("_new").over(in_slot.rowsBetween(Window.unboundedPreceding, 0))))
    # sessions begun in earlier slots of the user
    begun = marked.groupBy(user, "_slot").agg(F.sum("_new").alias("_begun"))
    offset = begun.select(user, "_slot", (F.sum("_begun").over(by_user) - F.col("_begun")).alias("_offset"))
    return (marked.join(offset, [user, "_slot"])
            .withColumn("session_no", F.col("_offset") + F.col("_nth"))
            .drop("_slot", "_before", "_prev", "_new", "_nth", "_offset"))


def session_table(events: DataFrame, gap_minutes: int = 30, user: str = "user_id", ts: str = "ts", slot: str = SLOT,
                  fields: list[str] | None = None) -> DataFrame:
    """One row per session: start, end (last event + gap), events, value. `fields`: also
    the events themselves, as an array `session` of these columns, sorted by them."""
    nested = [F.array_sort(F.collect_list(F.struct(*fields))).alias("session")] if fields else []
    gap = F.expr(f"INTERVAL {gap_minutes} MINUTES")
    return (sessionize(events, gap_minutes, user, ts, slot).groupBy(user, "session_no")
            .agg(F.min(ts).alias("session_start"), (F.max(ts) + gap).alias("session_end"),
                 F.count(F.lit(1)).alias("n_events"),
                 F.sum(F.col("value").cast("decimal(38,9)")).cast("double").alias("total"), *nested))
