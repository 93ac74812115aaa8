"""Readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from clientele.session import scratch_dir


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Headered CSV with a fixed schema (no inference pass). Accepts a glob."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def write_table(df: DataFrame, path: str, partition: str | None = None, mode: str = "overwrite",
                comments: T.StructType | None = None, gather: bool = True) -> None:
    """Create or replace a table, by day if a partition column is named.

    `comments`: a schema whose descriptions are stored with the columns of the same
    name. `rebalance` lets the adaptive planner gather the rows of a day into few files
    and split a day that is larger than the target size; that moves all rows once more, so
    `gather` = False leaves it out where periods are few and a task has rows of each anyway."""
    if comments is not None:
        described = {f.name: f.metadata for f in comments.fields if f.metadata}
        df = df.select(*[F.col(c).alias(c, metadata=described[c]) if c in described else F.col(c) for c in df.columns])
    if partition:
        (df.hint("rebalance", partition) if gather else df).write.mode(mode).partitionBy(partition).parquet(path)
    else:
        df.write.mode(mode).parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    """Append; creates the table when it does not exist."""
    df.write.mode("append").parquet(path)


def replace_days(df: DataFrame, path: str, partition: str, day: str = "session_day") -> None:
    """Rewrite only the days present in `df`; running it twice changes nothing.

    A partition may hold more than one day (months, years). Its other days are read
    and written along; they wait in the scratch folder while the partition is replaced."""
    spark, kept = df.sparkSession, scratch_dir(df.sparkSession, "kept-days")
    stored = spark.read.parquet(path)
    periods = df.select(partition).distinct()
    days = df.select(F.to_date(day).alias("_day")).distinct()
    (stored.join(periods, partition, "left_semi").withColumn("_day", F.to_date(day))
     .join(days, "_day", "left_anti").drop("_day").write.parquet(kept))
    rows = df.unionByName(spark.read.schema(stored.schema).parquet(kept))
    (rows.hint("rebalance", partition).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path))


def capped(df: DataFrame, rows: int = 100) -> DataFrame:
    """At most so many result rows for display."""
    return df.limit(rows)


def swap_table(df: DataFrame, path: str) -> None:
    """Replace a small table by rows that may be read from it: they wait in the scratch
    folder while it is overwritten."""
    spark, kept = df.sparkSession, scratch_dir(df.sparkSession, "swapped")
    df.write.parquet(kept)
    spark.read.parquet(kept).write.mode("overwrite").parquet(path)
