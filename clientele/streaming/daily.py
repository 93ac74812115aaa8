"""Incremental versions: daily sums, sessions and the log sink.

A batch leaves partial results that are merged when the table is read; no row is too
late to count. Only `indexed_sink` keeps state between batches: the ids it has seen."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from clientele.functions.dates import utc_ntz, utc_timestamp
from clientele.functions.money import numeric_sum
from clientele.operators.corpus import store_new
from clientele.operators.sessionize import session_table
from clientele.session import scratch_dir
from clientele.sources import versions

GAP_MINUTES = 30

RAW_EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def read_events(spark: SparkSession, path: str, schema: T.StructType = RAW_EVENTS,
                files_per_batch: int | None = None) -> DataFrame:
    """Files appearing at `path` as a stream. Event time must be a zoned
    timestamp for a watermark, so the zone-less `ts` is read as UTC."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path).withColumn("ts", utc_timestamp(F.col("ts")))


def run_batches(stream: DataFrame, partial: Callable[[DataFrame], DataFrame], name: str, out: str | None = None,
                checkpoint: str | None = None, merge: Callable[[DataFrame], DataFrame] | None = None,
                fan_in: int = versions.FAN_IN) -> DataFrame:
    """Reduce every batch of the stream with `partial`, store the result, and read all
    results. Nothing waits for a watermark, so late rows and open days count.

    A batch is a run of its own; a repeated batch is stored once. With `merge` (see
    `versions.add_run`) runs are compacted, so that a read meets few of them. With the same
    `out` and `checkpoint` the next call goes on where this one stopped; the two belong together."""
    spark = stream.sparkSession
    out = out or scratch_dir(spark, name)
    schema = partial(spark.createDataFrame([], stream.schema)).schema

    def store(rows: DataFrame, number: int) -> None:
        versions.add_run(partial(rows), out, number, merge, fan_in)

    _run(stream, store, checkpoint or f"{out}-checkpoint")
    return versions.read(spark, out, schema)


def _run(stream: DataFrame, store: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    (stream.writeStream.foreachBatch(store).trigger(availableNow=True)
     .option("checkpointLocation", checkpoint).start().awaitTermination())


def daily_parts(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Count and sum per keys and UTC day of the rows of one batch."""
    day = F.date_trunc("day", utc_ntz(F.col("ts"))).cast("timestamp_ntz")
    return rows.groupBy(*keys, day.alias("day")).agg(
        F.count(F.lit(1)).alias("n_events"), numeric_sum(F.col(value)).alias("total"))


def merge_days(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Parts of several batches as the parts of one."""
    return parts.groupBy(*keys, "day").agg(F.sum("n_events").alias("n_events"), F.sum("total").alias("total"))


def daily_totals(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Days put together from the parts of all batches."""
    return merge_days(parts, keys).withColumn("total", F.col("total").cast("double"))


def session_parts(rows: DataFrame, gap_minutes: int = GAP_MINUTES, fields: list[str] | None = None) -> DataFrame:
    """Sessions within one batch; `fields`: with their events as an array `session`."""
    zoneless = rows.withColumn("ts", utc_ntz(F.col("ts")))
    return session_table(zoneless, gap_minutes, fields=fields).drop("session_no")


def merge_sessions(parts: DataFrame) -> DataFrame:
    """Sessions of a user whose pauses a later batch has filled become one; the end of
    a part already includes the gap. Sorts the parts of a user, not the events. Arrays of
    events are joined and keep their order."""
    by_start = Window.partitionBy("user_id").orderBy("session_start", "session_end")
    before = F.max("session_end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    new = (before.isNull() | (F.col("session_start") > before)).cast("long")
    numbered = parts.withColumn("_new", new).withColumn("_no", F.sum("_new").over(by_start))
    nested = [F.array_sort(F.flatten(F.collect_list("session"))).alias("session")] if "session" in parts.columns else []
    return numbered.groupBy("user_id", "_no").agg(
        F.min("session_start").alias("session_start"), F.max("session_end").alias("session_end"),
        F.sum("n_events").alias("n_events"), F.sum(F.col("total").cast("decimal(38,9)")).cast("double").alias("total"),
        *nested).drop("_no")


def log_sink(rows: DataFrame, name: str, out: str | None = None, checkpoint: str | None = None,
             id_: str = "id") -> DataFrame:
    """Store every log row once, however late it or its copies come, and read the table.

    A batch is held against the ids that are stored: only that column is read."""
    spark = rows.sparkSession
    out = out or scratch_dir(spark, name)

    def store(batch: DataFrame, number: int) -> None:
        store_new(batch, out, id_, ["ts"])

    spark.createDataFrame([], rows.schema).write.mode("append").parquet(out)
    _run(rows, store, checkpoint or f"{out}-checkpoint")
    return spark.read.schema(rows.schema).parquet(out)


STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # a batch uploads what it has changed, not the whole store
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def indexed_sink(rows: DataFrame, name: str, out: str | None = None, checkpoint: str | None = None,
                 id_: str = "id") -> DataFrame:
    """As `log_sink`, but a batch never reads what is stored: the ids seen are state, dealt by
    their hash and kept on disk, and a batch asks for its own ids only. Ids are not forgotten, so a
    copy may come at any time; no watermark is needed.

    Copies of an id are taken for the same row: of different ones with that id the first batch
    decides, within a batch any one is stored (`log_sink` takes the earliest). All rows without an id
    count as copies of each other. The number of shuffle partitions of the first run stays."""
    spark = rows.sparkSession
    out = out or scratch_dir(spark, name)
    before = {key: spark.conf.get(key, None) for key in STATE_SETTINGS}
    for key, value in STATE_SETTINGS.items():
        spark.conf.set(key, value)
    try:
        (rows.dropDuplicates([id_]).writeStream.format("parquet").outputMode("append").queryName(name)
         .option("path", out).option("checkpointLocation", checkpoint or f"{out}-checkpoint")
         .trigger(availableNow=True).start().awaitTermination())
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    return spark.read.schema(rows.schema).parquet(out)
