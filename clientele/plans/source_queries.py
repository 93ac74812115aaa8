"""Registered queries: files, stored tables, streams. Each writes below the
scratch folder of the session and reads its own result back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from clientele.functions.dates import as_date, months_before, utc_ntz
from clientele.operators import history, products as prod, users as usr
from clientele.operators.segments import segment
from clientele.operators.sessionize import session_table
from clientele.plans import questions as q
from clientele.plans.dataset import PARTITION, build, demo_frames, demo_nested, period_of, stored_days
from clientele.plans.dataset_queries import brands_text
from clientele.plans.reference_sql import demo_sql, product_sql
from clientele.plans.registry import SQL, query
from clientele.plans.segment_queries import BRAND, COUNTRY, CUT_DAY, OTHER, _answer
from clientele.schemas import PRODUCTS, USERS
from clientele.session import scratch_dir
from clientele.sources import corpus_files, demo, tables, versions
from clientele.streaming import daily as stream

# --------------------------------------------------------------------- files


@query("src_csv_users", demo_sql("""
SELECT id, first_name, last_name, gender, age, state, NULL AS street_address, NULL AS postal_code, NULL AS city, country,
       email, NULL AS created_at FROM users"""))
def src_csv_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "users-csv")
    tables.write_csv(demo.users(spark, sf_dir), path)
    return tables.read_csv(spark, f"{path}/part-*.csv", USERS)


@query("src_csv_products", demo_sql("""
SELECT id, cost, category, name, brand, retail_price, department, sku, distribution_center_id FROM products"""))
def src_csv_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "products-csv")
    tables.write_csv(demo.products(spark, sf_dir), path)
    return tables.read_csv(spark, path, PRODUCTS)


@query("sample_corpus_load", """
SELECT role AS table_name, text AS question, 'SELECT ' || CAST(turn AS VARCHAR) AS sql_query FROM conversations
WHERE role IN ('user', 'assistant')""")
def sample_corpus_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three folders of samples, two of them asked for, and one name without a folder."""
    path = scratch_dir(spark, "samples")
    c = demo.table(spark, sf_dir, "conversations")
    corpus_files.write_samples(c.select(F.col("text").alias("question"), F.concat(
        F.lit("SELECT "), F.col("turn").cast("string")).alias("sql_query"), F.col("role").alias("table_name")), path)
    return corpus_files.read_samples(spark, path, ["user", "assistant", "missing"])


# ------------------------------------------------------------- stored tables

GRAIN = "YEAR"      # the provided tables hold a handful of rows per day


def _build(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return build(spark, demo.users(spark, sf_dir), demo.products(spark, sf_dir), demo.session_events(spark, sf_dir),
                 scratch_dir(spark, "tables"), GRAIN, [table], demo_nested(spark, sf_dir))[table]


@query("stored_user_aggregates", SQL["user_aggregates"])
def stored_user_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tables written and read step by step, from the nested events on."""
    return shown_aggregates(_build(spark, sf_dir, "user_aggregates"))


def shown_aggregates(rows: DataFrame) -> DataFrame:
    return rows.select(
        "user_id", "age", "gender", "country", "total_purchased_items", F.round("total_spend", 2).alias("total_spend"),
        "first_purchase_date", "last_purchase_date", "session_day", "daily_purchased_items",
        F.round("daily_spend", 2).alias("daily_spend"), brands_text(usr.DAILY_ARRAY).alias("daily_brands"),
        brands_text(usr.TOTAL_ARRAY).alias("total_brands"), "has_abandoned_cart")


@query("stored_product_aggregates", SQL["product_aggregates"])
def stored_product_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pa = _build(spark, sf_dir, "product_aggregates").drop(PARTITION)
    return (pa.withColumn("product_total_spend", F.round("product_total_spend", 2))
              .withColumn("daily_product_spend", F.round("daily_product_spend", 2)))


_BUILT: dict[tuple[str, str], str] = {}      # (application, tables): where the questions' tables are


def stored_tables(spark: SparkSession, sf_dir: str, months: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Stored user_aggregates and product_daily, built once per application: users ask
    many questions of tables that are there already. With `months` only the folders of
    the last months are opened."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        path = scratch_dir(spark, "questions")
        build(spark, demo.users(spark, sf_dir), demo.products(spark, sf_dir), demo.session_events(spark, sf_dir), path,
              GRAIN, ["user_aggregates", "product_daily"], demo_nested(spark, sf_dir))
        _BUILT[key] = path
    ua, daily = (tables.read_table(spark, f"{_BUILT[key]}/{name}") for name in ("user_aggregates", "product_daily"))
    if months is None:
        return ua, daily
    since, until = months_before(demo.AS_OF, months), as_date(demo.AS_OF)
    return stored_days(ua, since, until, GRAIN), stored_days(daily, since, until, GRAIN)


@query("stored_seg_q0", SQL["seg_q0"])
def stored_seg_q0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prod.top_products(stored_tables(spark, sf_dir, 12)[1], "product_id", 5)


@query("stored_seg_q1", SQL["seg_q1"])
def stored_seg_q1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(q.spenders_of_brand(stored_tables(spark, sf_dir)[0], BRAND, demo.AS_OF, months=24))


@query("stored_seg_q2", SQL["seg_q2"])
def stored_seg_q2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(q.young_locals_before(stored_tables(spark, sf_dir)[0], BRAND, COUNTRY, CUT_DAY))


@query("stored_seg_q3", SQL["seg_q3"])
def stored_seg_q3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(q.young_lapsed(stored_tables(spark, sf_dir)[0], BRAND, CUT_DAY))


@query("stored_seg_q4", SQL["seg_q4"])
def stored_seg_q4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(q.recent_spenders(stored_tables(spark, sf_dir, 3)[0], demo.AS_OF, amount=10000))


@query("stored_seg_q5", SQL["seg_q5"])
def stored_seg_q5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(q.loyal_without(stored_tables(spark, sf_dir)[0], BRAND, OTHER, demo.AS_OF))


@query("stored_seg_q6", SQL["seg_q6"])
def stored_seg_q6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(segment(stored_tables(spark, sf_dir, 12)[0]).bought(BRAND, min_items=2))


@query("stored_seg_q7", SQL["seg_q7"])
def stored_seg_q7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(q.buyers_of_top(*stored_tables(spark, sf_dir, 3), demo.AS_OF, months=3))


@query("stored_seg_q8", SQL["seg_q8"])
def stored_seg_q8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(q.buyers_of_top(*stored_tables(spark, sf_dir, 12), demo.AS_OF, months=12, at_least=2))


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prod.product_daily(demo_frames(spark, sf_dir, country=True).priced)
    return rows.withColumn(PARTITION, period_of(F.col("session_day"), GRAIN))


def _daily_sql(times: int) -> str:
    return product_sql(f"""SELECT country, count(*) * {times} AS n_rows,
CAST(sum(daily_product_purchased_items) AS BIGINT) * {times} AS items FROM product_daily GROUP BY country""")


def _summary(df: DataFrame) -> DataFrame:
    return df.groupBy("country").agg(F.count(F.lit(1)).alias("n_rows"),
                                     F.sum("daily_product_purchased_items").alias("items"))


@query("sink_append", _daily_sql(2))
def sink_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appending the same rows twice doubles them."""
    path = scratch_dir(spark, "append")
    tables.append_rows(_daily(spark, sf_dir), path)
    tables.append_rows(tables.read_table(spark, path), path)
    return _summary(tables.read_table(spark, path))


@query("sink_replace_days", _daily_sql(1))
def sink_replace_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replacing days twice leaves them as they are; other days are untouched."""
    path = scratch_dir(spark, "replace")
    tables.write_table(_daily(spark, sf_dir), path, PARTITION)
    again = tables.read_table(spark, path).where(F.col(PARTITION) >= "2000-01-01")
    copy = scratch_dir(spark, "replace-copy")
    tables.write_table(again, copy)
    tables.replace_days(tables.read_table(spark, copy), path, PARTITION)
    return _summary(tables.read_table(spark, path))


ONE_DAY = "2000-06-01"


@query("sink_replace_one_day", product_sql(f"""
SELECT country, count(*) AS n_rows, CAST(sum(daily_product_purchased_items
         + CASE WHEN CAST(session_day AS DATE) = DATE '{ONE_DAY}' THEN 1 ELSE 0 END) AS BIGINT) AS items
FROM product_daily GROUP BY country"""))
def sink_replace_one_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One day of a year is replaced; the other days of that year stay."""
    path = scratch_dir(spark, "replace-one")
    tables.write_table(_daily(spark, sf_dir), path, PARTITION)
    day = tables.read_table(spark, path).where(F.to_date("session_day") == F.lit(ONE_DAY).cast("date"))
    more = day.withColumn("daily_product_purchased_items", F.col("daily_product_purchased_items") + 1)
    copy = scratch_dir(spark, "replace-one-copy")
    tables.write_table(more, copy)
    tables.replace_days(tables.read_table(spark, copy), path, PARTITION)
    return _summary(tables.read_table(spark, path))


FIRST_DAY, LAST_DAY, ADDED_DAY = "2000-01-01", "2000-02-29", "2000-03-01"


@query("stored_by_day", product_sql(f"""
SELECT country, count(*) AS n_rows, CAST(sum(daily_product_purchased_items) AS BIGINT) AS items FROM product_daily
WHERE CAST(session_day AS DATE) BETWEEN DATE '{FIRST_DAY}' AND DATE '{ADDED_DAY}' GROUP BY country"""))
def stored_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two months stored by day from the events on; then one more day is added, twice."""
    path = scratch_dir(spark, "by-day")
    raw = demo.session_events(spark, sf_dir)
    day = F.to_date("session_created_at")
    build(spark, demo.users(spark, sf_dir), demo.products(spark, sf_dir), raw.where(day.between(FIRST_DAY, LAST_DAY)), path,
          wanted=["product_daily"])
    added = demo_frames(spark, sf_dir, country=True).product_daily().where(F.to_date("session_day") == ADDED_DAY)
    for _ in range(2):
        tables.replace_days(added.withColumn(PARTITION, period_of(F.col("session_day"))), f"{path}/product_daily", PARTITION)
    return _summary(tables.read_table(spark, f"{path}/product_daily"))


@query("versioned_days", "SELECT event_id, ts, user_id, value, date_trunc('day', ts)::DATE AS session_date FROM events")
def versioned_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table by day, stored with false values from one day on, then corrected in a new version."""
    path, events = scratch_dir(spark, "versioned"), demo.table(spark, sf_dir, "events")
    rows = events.select("event_id", "ts", "user_id", "value", F.to_date("ts").alias("session_date"))
    wrong = F.col("ts") >= "2024-01-10"
    versions.replace_days(rows.withColumn("value", F.when(~wrong, F.col("value"))), path, "session_date", "ts")
    versions.replace_days(rows.where(wrong), path, "session_date", "ts")
    return versions.read(spark, path, rows.schema)


# ------------------------------------------------------------------- streams


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a pattern, because a stream cannot start from the path of one single file; it fits that name only
    return stream.read_events(spark, f"{sf_dir}/event[s].parquet")


def _day_sql(key: str, only: str = "TRUE") -> str:
    return f"""
SELECT {key}, date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n_events,
       round(CAST(sum(CAST(value AS DECIMAL(38,9))) AS DOUBLE), 2) AS total
FROM events WHERE {only} GROUP BY 1, 2"""


def _stream_daily(rows: DataFrame, key: str) -> DataFrame:
    parts = stream.run_batches(rows, lambda batch: stream.daily_parts(batch, [key]), f"{key}-daily",
                               merge=lambda runs: stream.merge_days(runs, [key]))
    return stream.daily_totals(parts, [key]).withColumn("total", F.round("total", 2))


@query("stream_user_daily", _day_sql("user_id", "event_type = 'purchase'"))
def stream_user_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream_daily(_events(spark, sf_dir).where(F.col("event_type") == "purchase"), "user_id")


@query("stream_type_daily", _day_sql("event_type"))
def stream_type_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream_daily(_events(spark, sf_dir), "event_type")


def _deliveries(spark: SparkSession, sf_dir: str, files: int) -> DataFrame:
    """All events as a stream of so many batches; rows of a day or user come in any of them."""
    source = scratch_dir(spark, "deliveries")
    demo.table(spark, sf_dir, "events").repartition(files, "event_id").write.parquet(source)
    return stream.read_events(spark, source, files_per_batch=1)


@query("stream_days_compacted", _day_sql("user_id"))
def stream_days_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten batches whose parts are merged three at a time while they come in."""
    parts = stream.run_batches(_deliveries(spark, sf_dir, 10), lambda batch: stream.daily_parts(batch, ["user_id"]), "compacted",
                               merge=lambda runs: stream.merge_days(runs, ["user_id"]), fan_in=3)
    return stream.daily_totals(parts, ["user_id"]).withColumn("total", F.round("total", 2))


_SESSIONS = """
WITH marked AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM marked),
sessions AS (SELECT user_id, no, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n_events,
                    round(CAST(sum(CAST(value AS DECIMAL(38,9))) AS DOUBLE), 2) AS total FROM numbered GROUP BY user_id, no)
"""


@query("sessionize_events", _SESSIONS + """
SELECT user_id, CAST(no AS BIGINT) AS session_no, session_start, session_end, n_events, total FROM sessions""")
def sessionize_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_table(demo.table(spark, sf_dir, "events")).withColumn("total", F.round("total", 2))


_NESTED = _SESSIONS + """
SELECT user_id, session_start, n_events, total, types FROM sessions JOIN (
  SELECT user_id, no, string_agg(event_type || ':' || CAST(event_id AS VARCHAR), ' ' ORDER BY ts, event_id) AS types
  FROM numbered GROUP BY user_id, no) USING (user_id, no)"""
_EVENT = ["ts", "event_id", "event_type", "value"]


def _as_text(found: DataFrame) -> DataFrame:
    words = F.transform("session", lambda e: F.concat(e["event_type"], F.lit(":"), e["event_id"].cast("string")))
    return found.select("user_id", "session_start", "n_events", F.round("total", 2).alias("total"),
                        F.array_join(words, " ").alias("types"))


@query("sessionize_nested", _NESTED)
def sessionize_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with their events as an array, here written out as text."""
    return _as_text(session_table(demo.table(spark, sf_dir, "events"), fields=_EVENT))


@query("stream_sessions_nested", _NESTED)
def stream_sessions_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from five batches, each with events of any time, compacted three at a time."""
    parts = stream.run_batches(_deliveries(spark, sf_dir, 5), lambda batch: stream.session_parts(batch, fields=_EVENT),
                               "nested-sessions", merge=stream.merge_sessions, fan_in=3)
    return _as_text(stream.merge_sessions(parts))


@query("stream_sessions", _SESSIONS + """
SELECT user_id, session_start, session_end, n_events, total FROM sessions""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = stream.run_batches(_events(spark, sf_dir), stream.session_parts, "sessions", merge=stream.merge_sessions)
    return stream.merge_sessions(parts).withColumn("total", F.round("total", 2))


def _log_rows(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_id").alias("id"), "ts", "event_type", "user_id")


@query("stream_qlog_sink", "SELECT event_id AS id, ts, event_type, user_id FROM events")
def stream_qlog_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every log row is delivered twice and stored once."""
    rows = _log_rows(_events(spark, sf_dir))
    return stream.log_sink(rows.unionByName(rows), "query-log").withColumn("ts", utc_ntz(F.col("ts")))


@query("stream_qlog_late", "SELECT event_id AS id, ts, event_type, user_id FROM events")
def stream_qlog_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three deliveries, newest rows first: what comes days late is stored all the same."""
    source, out = scratch_dir(spark, "late-in"), scratch_dir(spark, "late-log")
    events = demo.table(spark, sf_dir, "events")
    for part in ("ts >= '2024-01-20'", "ts >= '2024-01-10'", "true"):
        events.where(part).write.mode("append").parquet(source)
        stored = stream.log_sink(_log_rows(stream.read_events(spark, source)), "late", out)
    return stored.withColumn("ts", utc_ntz(F.col("ts")))


@query("stream_qlog_indexed", "SELECT event_id AS id, ts, event_type, user_id FROM events")
def stream_qlog_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six batches, each row in two of them, stored once by an index of the ids."""
    source, events = scratch_dir(spark, "twice-in"), demo.table(spark, sf_dir, "events")
    for seed in (1, 2):
        events.repartition(3, F.xxhash64("event_id", F.lit(seed))).write.mode("append").parquet(source)
    rows = _log_rows(stream.read_events(spark, source, files_per_batch=1))
    return stream.indexed_sink(rows, "indexed-log").withColumn("ts", utc_ntz(F.col("ts")))


# From this day on, days are added to tables that were built without them.
LATER_DAY, CORRECTED_DAY = dt.date(2000, 6, 1), dt.date(1999, 3, 4)


@query("history_user_aggregates", SQL["user_aggregates"])
def history_user_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built up to a day without one of the days, then the later days are added in one run,
    twice, and the missing one. Every day is replaced alone, in folders of a month."""
    f = demo_frames(spark, sf_dir)
    path = scratch_dir(spark, "history")

    f.lines.write.parquet(f"{path}/arrived/lines")         # as they come in, day by day
    f.marks.write.parquet(f"{path}/arrived/marks")
    lines, marks = (spark.read.parquet(f"{path}/arrived/{name}") for name in ("lines", "marks"))

    def at(test):
        return lines.where(test(F.to_date("session_day"))), marks.where(test(F.to_date("session_created_at")))

    later, corrected = F.lit(LATER_DAY), F.lit(CORRECTED_DAY)
    history.create(*at(lambda day: (day < later) & (day != corrected)), path, grain="MONTH")
    for test in (lambda day: day >= later, lambda day: day >= later, lambda day: day == corrected):
        history.add_days(*at(test), path, grain="MONTH")
    return shown_aggregates(history.read_aggregates(spark, f.users, path))
