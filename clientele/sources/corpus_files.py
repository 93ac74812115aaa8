"""Sample question files: one folder of JSON lines per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SAMPLES = "question string, sql_query string, table_name string"


def write_samples(samples: DataFrame, path: str) -> None:
    samples.write.mode("overwrite").partitionBy("table_name").json(path)


def read_samples(spark: SparkSession, path: str, tables: list[str] | None = None) -> DataFrame:
    """Samples of the listed tables; a table without a folder adds nothing, and
    folders of other tables are not opened (partition pruning)."""
    rows = spark.read.schema(SAMPLES).json(path)
    return rows.where(F.col("table_name").isin(tables)) if tables else rows
