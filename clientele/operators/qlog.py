"""The query log: appending, error analysis, failure rates, durations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clientele.functions.money import rounded_seconds
from clientele.functions.text import first_match
from clientele.schemas import QUERY_LOG
from clientele.sources.tables import append_rows

# Error codes by class.
RETRYABLE, PERMISSION, BAD_QUERY = (500, 503), (403, 409), (400, 404)


def typed_log(rows: DataFrame) -> DataFrame:
    """The columns of the log in their order and types; missing ones are NULL."""
    def column(field):
        value = F.col(field.name) if field.name in rows.columns else F.lit(None)
        return value.cast(field.dataType).alias(field.name)
    return rows.select(*[column(f) for f in QUERY_LOG.fields])


def append_log(rows: DataFrame, path: str) -> None:
    """Add rows to the log table, creating it on first use."""
    append_rows(typed_log(rows), path)


def parse_errors(rows: DataFrame, message: str = "error_msg") -> DataFrame:
    """Adds error_code (first number after 'Reason: ') and error_text (the part
    before the location paragraph). Without a reason the code is NULL."""
    return (rows.withColumn("error_code", first_match(F.col(message), r"Reason: (\d+)").cast("int"))
                .withColumn("error_text", F.split_part(F.col(message), F.lit("\n\nLocation"), F.lit(1))))


def classify_errors(rows: DataFrame, engine: str = "Warehouse", retries: str | None = None, max_retries: int = 5) -> DataFrame:
    """Adds error_type and retryable. A retryable error turns into an internal
    one when the column `retries` says the attempts are used up."""
    code = F.col("error_code")
    again = code.isin(*RETRYABLE)
    spent = F.lit(False) if retries is None else F.col(retries) >= max_retries
    kind = (F.when(again & spent, f"{engine} Internal Error").when(again, F.lit(None).cast("string"))
            .when(code.isin(*PERMISSION), "Permission Error").when(code.isin(*BAD_QUERY), "Bad SQL Query")
            .otherwise(f"Undefined {engine} Error"))
    return (rows.withColumn("retryable", F.coalesce(again & ~spent, F.lit(False)))
                .withColumn("error_type", F.when(F.col("error_msg").isNotNull(), kind)))


def failure_rates(rows: DataFrame) -> DataFrame:
    return rows.groupBy("failure_step", "found_in_vector", "need_rewrite").agg(F.count(F.lit(1)).alias("n"))


def stage_durations(rows: DataFrame, stages: list[str]) -> DataFrame:
    """Durations for the report: -1 means the stage did not run."""
    keep = [c for c in rows.columns if c not in stages]
    return rows.select(*keep, *[rounded_seconds(F.col(s)).alias(s) for s in stages])
