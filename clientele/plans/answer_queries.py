"""Registered queries: catalogue, validation, query log, result shaping."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clientele.functions.dates import rand_date
from clientele.functions.money import round_half_away
from clientele.functions.nested import number_range, pick
from clientele.functions.text import one_line, strip_fences
from clientele.operators import catalog as cat, qlog, shape, validation as val
from clientele.plans.dataset import demo_frames
from clientele.plans.registry import query
from clientele.schemas import PRODUCT_AGGREGATES, TABLE_COMMENTS, USER_AGGREGATES
from clientele.session import scratch_dir
from clientele.sources import demo
from clientele.sources.demo import table
from clientele.sources.tables import capped

# ---------------------------------------------------------------- catalogue
# A large catalogue out of the provided tables: an order is a table, its line
# numbers are columns and its lines are the field paths below them.

_CAT = """
WITH cols AS (
  SELECT DISTINCT 'shop' AS project_id, o_orderpriority AS owner, 'order_' || CAST(o_orderkey AS VARCHAR) AS table_name,
         'c' || CAST(l_linenumber AS VARCHAR) AS column_name
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
paths AS (
  SELECT DISTINCT 'shop' AS project_id, o_orderpriority AS owner, 'order_' || CAST(o_orderkey AS VARCHAR) AS table_name,
         'c' || CAST(l_linenumber AS VARCHAR) AS column_name,
         'c' || CAST(l_linenumber AS VARCHAR) || '.p' || CAST(l_partkey AS VARCHAR) AS field_path,
         CASE p_size % 2 WHEN 0 THEN 'STRING' ELSE 'INT64' END AS data_type,
         p_name || ' - Scope: ' || CASE WHEN p_size > 25 THEN 'global' WHEN p_size > 5 THEN 'time-dependent' ELSE 'none' END
           AS description
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
cons AS (
  SELECT p || '_' || CAST(o_orderkey AS VARCHAR) AS constraint_name, 'shop' AS project_id, o_orderpriority AS owner,
         'order_' || CAST(o_orderkey AS VARCHAR) AS table_name, t AS constraint_type
  FROM orders, (VALUES ('pk', 'PRIMARY KEY'), ('fk', 'FOREIGN KEY')) k(p, t)),
usage AS (
  SELECT DISTINCT CASE l_linestatus WHEN 'O' THEN 'pk_' ELSE 'fk_' END || CAST(l_orderkey AS VARCHAR) AS constraint_name,
         'c' || CAST(l_linenumber AS VARCHAR) AS column_name, 'stock' AS r_owner,
         'supplier_' || CAST(l_suppkey AS VARCHAR) AS r_table_name, 'p' || CAST(l_partkey AS VARCHAR) AS r_column_name
  FROM lineitem)
"""
_OWNERS = ["1-URGENT", "5-LOW"]


def _catalogue(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Columns and paths meet the orders by table name: what the catalogue does next goes by it
    too, so they need not move again. Up to there they move as numbers, not as texts."""
    def name(key: str) -> Column:
        return F.concat(F.lit("order_"), F.col(key).cast("string")).alias("table_name")

    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.lit("shop").alias("project_id"), F.col("o_orderpriority").alias("owner"), name("o_orderkey"), "o_orderstatus")
    lines = table(spark, sf_dir, "lineitem")
    number = F.concat(F.lit("c"), F.col("l_linenumber").cast("string"))
    part = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    columns = (lines.select(name("l_orderkey"), "l_linenumber").repartition("table_name").distinct()
               .join(orders.select(*cat.TABLE_KEY), "table_name")
               .select(*cat.TABLE_KEY, number.alias("column_name"), F.lit(True).alias("is_nullable")))
    scope = F.when(F.col("p_size") > 25, "global").when(F.col("p_size") > 5, "time-dependent").otherwise("none")
    paths = (lines.select("l_orderkey", "l_partkey", "l_linenumber").distinct()
             .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
             .select(name("l_orderkey"), "l_linenumber", "l_partkey", "p_name", "p_size")
             .join(orders.select(*cat.TABLE_KEY), "table_name")
             .select(*cat.TABLE_KEY, number.alias("column_name"), F.concat(number, F.lit("."), part).alias("field_path"),
                     F.when(F.col("p_size") % 2 == 0, "STRING").otherwise("INT64").alias("data_type"),
                     F.concat("p_name", F.lit(" - Scope: "), scope).alias("description")))
    kinds = F.explode(F.array(F.struct(F.lit("pk").alias("p"), F.lit("PRIMARY KEY").alias("constraint_type")),
                              F.struct(F.lit("fk").alias("p"), F.lit("FOREIGN KEY").alias("constraint_type"))))
    constraints = orders.select("*", kinds.alias("k")).select(
        F.concat("k.p", F.lit("_"), F.col("o_orderkey").cast("string")).alias("constraint_name"), *cat.TABLE_KEY,
        "k.constraint_type")
    prefix = F.when(F.col("l_linestatus") == "O", "pk_").otherwise("fk_")
    usage = lines.select(
        F.concat(prefix, F.col("l_orderkey").cast("string")).alias("constraint_name"), "l_linenumber", "l_suppkey",
        "l_partkey").repartition("constraint_name").distinct().select(
        "constraint_name", number.alias("column_name"), F.lit("stock").alias("r_owner"),
        F.concat(F.lit("supplier_"), F.col("l_suppkey").cast("string")).alias("r_table_name"), part.alias("r_column_name"))
    options = orders.select(*cat.TABLE_KEY, F.lit("description").alias("option_name"),
                            F.concat(F.lit('"Order in state '), "o_orderstatus", F.lit('"')).alias("option_value"))
    return {"columns": columns, "paths": paths, "constraints": constraints, "usage": usage, "options": options}


_FIELDS = """
SELECT project_id, owner, table_name, column_name, field_path, data_type, description,
       CASE WHEN description LIKE '%Scope: global' THEN 'global' WHEN description LIKE '%Scope: time-dependent'
            THEN 'time-dependent' END AS scope
FROM cols JOIN paths USING (project_id, owner, table_name, column_name)"""


@query("catalog_fields", _CAT + _FIELDS)
def catalog_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _catalogue(spark, sf_dir)
    return cat.catalog_fields(c["columns"], c["paths"]).drop("is_nullable")


@query("catalog_own_tables")
def catalog_own_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The described schemas of the stored tables, nested paths and comments included,
    with the number of rows each table has over the provided data."""
    frames = demo_frames(spark, sf_dir, country=True)
    sizes = None
    for name, rows in (("user_aggregates", frames.user_aggregates(daily=False, total=False)),
                       ("product_aggregates", frames.product_aggregates())):
        n = rows.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        sizes = n if sizes is None else sizes.unionByName(n)
    fields = cat.own_tables(spark, "shop", "cdp", {"user_aggregates": USER_AGGREGATES, "product_aggregates": PRODUCT_AGGREGATES},
                            TABLE_COMMENTS)
    return cat.in_order(fields.join(sizes, "table_name"), "column_name", "field_path")


@query("catalog_filtered", _CAT + """
SELECT owner, table_name, count(*) AS n_columns FROM cols
WHERE CASE WHEN len(['1-URGENT', '5-LOW']) > 0 THEN owner IN ('1-URGENT', '5-LOW') ELSE TRUE END GROUP BY ALL""")
def catalog_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = _catalogue(spark, sf_dir)["columns"]
    return (columns.where(cat.listed(_OWNERS, F.col("owner"))).groupBy("owner", "table_name")
            .agg(F.count(F.lit(1)).alias("n_columns")))


@query("catalog_keys", _CAT + """
SELECT c.constraint_name, constraint_type, owner, table_name, column_name, r_owner, r_table_name, r_column_name
FROM cons c JOIN usage u ON c.constraint_name = u.constraint_name""")
def catalog_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _catalogue(spark, sf_dir)
    both = [cat.catalog_keys(c["constraints"], c["usage"], kind) for kind in ("PRIMARY KEY", "FOREIGN KEY")]
    return both[0].unionByName(both[1]).select("constraint_name", "constraint_type", "owner", "table_name", "column_name",
                                               "r_owner", "r_table_name", "r_column_name")


@query("table_descriptions", _CAT + f""",
f AS (SELECT owner, table_name, string_agg('- ' || field_path || ' (' || data_type || ') - ' || description,
        ' ' || chr(10) || '  ' ORDER BY column_name, field_path) AS t FROM ({_FIELDS}) GROUP BY ALL),
k AS (SELECT c.constraint_type, owner, table_name, u.* EXCLUDE (constraint_name)
      FROM cons c JOIN usage u ON c.constraint_name = u.constraint_name),
pk AS (SELECT owner, table_name, string_agg(column_name, ',' ORDER BY column_name) AS t FROM k
       WHERE constraint_type = 'PRIMARY KEY' GROUP BY ALL),
fk AS (SELECT owner, table_name, string_agg(chr(10) || '      Column ' || column_name || ' is equal to column ' || r_column_name
         || ' in table ' || r_owner || '.' || r_table_name || chr(10) || '      ', ','
         ORDER BY column_name, r_owner, r_table_name, r_column_name) AS t FROM k
       WHERE constraint_type = 'FOREIGN KEY' GROUP BY ALL),
tabs AS (SELECT 'shop' AS project_id, o_orderpriority AS owner, 'order_' || CAST(o_orderkey AS VARCHAR) AS table_name,
                'Order in state ' || o_orderstatus AS comments FROM orders)
SELECT project_id, tabs.owner, tabs.table_name,
  chr(10) || '  Table: `' || project_id || '.' || tabs.owner || '.' || tabs.table_name || '`' || chr(10) || '  Owner: ' || tabs.owner
  || chr(10) || '  Columns:' || chr(10) || '  ' || coalesce(f.t, '')
  || chr(10) || '  Primary Key: ' || coalesce(pk.t, 'None') || chr(10) || '  Foreign Keys: ' || coalesce(fk.t, 'None')
  || chr(10) || '  Project_id: ' || project_id || chr(10) || '  Table Description: ' || comments AS detailed_description
FROM tabs LEFT JOIN f ON tabs.owner = f.owner AND tabs.table_name = f.table_name
LEFT JOIN pk ON tabs.owner = pk.owner AND tabs.table_name = pk.table_name
LEFT JOIN fk ON tabs.owner = fk.owner AND tabs.table_name = fk.table_name""")
def table_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _catalogue(spark, sf_dir)
    return cat.table_descriptions(
        cat.table_comments(c["options"]), cat.catalog_fields(c["columns"], c["paths"]),
        cat.catalog_keys(c["constraints"], c["usage"], "PRIMARY KEY"),
        cat.catalog_keys(c["constraints"], c["usage"], "FOREIGN KEY"))


# --------------------------------------------------------------- validation
# One reply per event. Every seventh is cut short, every seventh lacks a part.

_REPLIES = """
WITH r AS (
  SELECT event_id, event_id % 7 IN (0, 1, 2) AS bad, 'question ' || CAST(event_id AS VARCHAR) AS asked,
         'last ' || event_type AS fa, 'ever ' || event_type AS fb,
         CASE WHEN value < 50 THEN 'global' ELSE 'time-dependent' END AS ca,
         user_id % 2 = 0 AS ra, event_id % 3 <> 0 AS rb FROM events),
c AS (
  SELECT event_id, bad, asked, 0 AS f, 0 AS c, fa AS filter_name, ca AS classification, 'total_spend' AS column_name,
         'global' AS scope, ra AS is_relevant FROM r
  UNION ALL SELECT event_id, bad, asked, 0, 1, fa, ca, 'session_day', 'time-dependent', TRUE FROM r
  UNION ALL SELECT event_id, bad, asked, 1, 0, fb, 'global', 'brand_name', 'both', rb FROM r),
m AS (
  SELECT *, scope <> 'both' AND scope <> classification AS wrong, CASE WHEN scope <> 'both' AND scope <> classification THEN
    '- "' || filter_name || '" is implemented using column ''' || column_name || ''' with scope ''' || scope
    || '''. Use a column with scope ''' || CASE scope WHEN 'global' THEN 'time-dependent' ELSE 'global' END
    || ''' instead.' || chr(10) ELSE '' END
    || CASE WHEN NOT is_relevant THEN '- The column ''' || column_name
    || ''' is either not relevant or not used correctly to implement the filter ''' || filter_name || '''.' || chr(10)
    ELSE '' END AS message FROM c)
"""


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")

    def column(name: str, scope: str, relevant: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), F.lit(scope).alias("scope"), relevant.alias("is_relevant"))

    first = F.struct(
        F.concat(F.lit("last "), "event_type").alias("name"),
        F.when(F.col("value") < 50, "global").otherwise("time-dependent").alias("classification"),
        F.array(column("total_spend", "global", F.col("user_id") % 2 == 0),
                column("session_day", "time-dependent", F.lit(True))).alias("columns"))
    second = F.struct(
        F.concat(F.lit("ever "), "event_type").alias("name"), F.lit("global").alias("classification"),
        F.array(column("brand_name", "both", F.col("event_id") % 3 != 0)).alias("columns"))
    good = F.to_json(F.struct(F.array(first, second).alias("filters"),
                              F.concat(F.lit("question "), F.col("event_id").cast("string")).alias("reversed_question")))
    kind = F.col("event_id") % 7
    reply = (F.when(kind == 0, F.substring(good, 1, 90))
             .when(kind == 1, F.replace(good, F.lit('"filters"'), F.lit('"parts"')))
             .when(kind == 2, F.replace(good, F.lit('"classification"'), F.lit('"class"')))
             .otherwise(good))
    return e.select("event_id", reply.alias("reply"))


@query("validation_parse", _REPLIES + """
SELECT event_id, bad AS malformed, CASE WHEN bad THEN NULL ELSE asked END AS reversed_question,
       CASE WHEN bad THEN 0 ELSE 2 END AS n_filters FROM r""")
def validation_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return val.parse_replies(replies(spark, sf_dir)).select(
        "event_id", "malformed", "reversed_question", F.coalesce(F.size("filters"), F.lit(0)).alias("n_filters"))


@query("validation_mismatches", _REPLIES + """
SELECT event_id, filter_name, column_name, 'scope' AS rule FROM m WHERE NOT bad AND wrong
UNION ALL SELECT event_id, filter_name, column_name, 'relevance' FROM m WHERE NOT bad AND NOT is_relevant""")
def validation_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return val.mismatches(val.filter_columns(replies(spark, sf_dir), "event_id")).select(
        "event_id", "filter_name", "column_name", "rule")


@query("validation_score", _REPLIES + """
SELECT event_id, CASE WHEN any_value(bad) THEN FALSE ELSE string_agg(message, '' ORDER BY f, c) = '' END AS is_matching,
       CASE WHEN any_value(bad) THEN 'Returned JSON malformed' ELSE string_agg(message, '' ORDER BY f, c) END
         AS mismatch_details,
       CASE WHEN any_value(bad) THEN NULL ELSE any_value(asked) END AS reversed_question
FROM m GROUP BY event_id""")
def validation_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return val.score_validation(replies(spark, sf_dir)).select(
        "event_id", "is_matching", "mismatch_details", "reversed_question")


@query("scope_lookup", _REPLIES + """
SELECT event_id, filter_name, column_name,
       CASE column_name WHEN 'total_spend' THEN 'global' WHEN 'session_day' THEN 'time-dependent'
            WHEN 'brand_name' THEN 'both' END AS catalog_scope,
       column_name = 'brand_name' OR classification = CASE column_name WHEN 'total_spend' THEN 'global'
         ELSE 'time-dependent' END AS fits
FROM c WHERE NOT bad""")
def scope_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scopes of the reply columns looked up in the schemas of the final tables."""
    fields = cat.schema_fields(spark, "shop", "cdp", {"user_aggregates": USER_AGGREGATES,
                                                      "product_aggregates": PRODUCT_AGGREGATES})
    fields = fields.where(~F.col("field_path").contains(".")).select("field_path", cat.scope_of(
        F.col("description")).alias("scope"))
    columns = val.filter_columns(replies(spark, sf_dir), "event_id")
    return val.scope_lookup(columns, fields).select("event_id", "filter_name", "column_name", "catalog_scope", "fits")


# ---------------------------------------------------------------- query log

_CODES = [400, 403, 404, 409, 500, 503, 418]
_LOG = """
WITH log AS (
  SELECT event_id, 'warehouse' AS source_type, 'shop' AS project_id, 'u' || CAST(user_id AS VARCHAR) AS "user", 'cdp' AS schema,
         CASE WHEN value < 50 THEN 'fast' ELSE 'fine' END AS model_used, 'question ' || CAST(event_id AS VARCHAR) AS question,
         'SELECT ' || CAST(event_id AS VARCHAR) AS generated_sql,
         CASE WHEN event_type = 'view' THEN 'Y' ELSE 'N' END AS found_in_vector,
         CASE WHEN event_type = 'click' THEN 'Y' ELSE 'N' END AS need_rewrite,
         CASE event_type WHEN 'error' THEN 'execution' WHEN 'click' THEN 'explain_plan_validation' ELSE '' END AS failure_step,
         CASE WHEN event_type <> 'error' THEN NULL WHEN event_id % 11 = 0 THEN 'No reason given'
              ELSE 'Reason: ' || CAST([400, 403, 404, 409, 500, 503, 418][event_id % 7 + 1] AS VARCHAR) || ' failed at '
                   || CAST(event_id AS VARCHAR) || chr(10) || chr(10) || 'Location: EU' END AS error_msg,
         ts AS execution_time, event_id % 7 AS tries FROM events),
parsed AS (
  SELECT *, CAST(nullif(regexp_extract(error_msg, 'Reason: (\\d+)', 1), '') AS INT) AS error_code,
         split_part(error_msg, chr(10) || chr(10) || 'Location', 1) AS error_text FROM log)
"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    key, kind = F.col("event_id").cast("string"), F.col("event_type")
    code = F.get(F.array(*[F.lit(c) for c in _CODES]), (F.col("event_id") % 7).cast("int")).cast("string")
    message = (F.when(kind != "error", F.lit(None).cast("string")).when(F.col("event_id") % 11 == 0, "No reason given")
               .otherwise(F.concat(F.lit("Reason: "), code, F.lit(" failed at "), key, F.lit("\n\nLocation: EU"))))
    return e.select(
        "event_id", F.lit("warehouse").alias("source_type"), F.lit("shop").alias("project_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user"), F.lit("cdp").alias("schema"),
        F.when(F.col("value") < 50, "fast").otherwise("fine").alias("model_used"),
        F.concat(F.lit("question "), key).alias("question"), F.concat(F.lit("SELECT "), key).alias("generated_sql"),
        F.when(kind == "view", "Y").otherwise("N").alias("found_in_vector"),
        F.when(kind == "click", "Y").otherwise("N").alias("need_rewrite"),
        F.when(kind == "error", "execution").when(kind == "click", "explain_plan_validation").otherwise("").alias("failure_step"),
        message.alias("error_msg"), F.col("ts").alias("execution_time"), (F.col("event_id") % 7).alias("tries"))


@query("qlog_append", _LOG + """
SELECT source_type, project_id, "user", schema, model_used, question, generated_sql, found_in_vector, need_rewrite,
       failure_step, error_msg, execution_time FROM log""")
def qlog_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors first (creates the table), everything else appended, read back."""
    path = scratch_dir(spark, "query-log")
    rows = _log(spark, sf_dir)
    qlog.append_log(rows.where(F.col("error_msg").isNotNull()), path)
    qlog.append_log(rows.where(F.col("error_msg").isNull()), path)
    return spark.read.parquet(path).withColumn("execution_time", F.col("execution_time").cast("timestamp_ntz"))


@query("qlog_error_parse", _LOG + "SELECT event_id, error_code, error_text FROM parsed WHERE error_msg IS NOT NULL")
def qlog_error_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qlog.parse_errors(_log(spark, sf_dir)).where(F.col("error_msg").isNotNull()).select(
        "event_id", "error_code", "error_text")


@query("qlog_error_class", _LOG + """
SELECT event_id, coalesce(error_code IN (500, 503) AND tries < 5, FALSE) AS retryable,
       CASE WHEN error_msg IS NULL THEN NULL WHEN error_code IN (500, 503) THEN
              CASE WHEN tries >= 5 THEN 'Warehouse Internal Error' END
            WHEN error_code IN (403, 409) THEN 'Permission Error' WHEN error_code IN (400, 404) THEN 'Bad SQL Query'
            ELSE 'Undefined Warehouse Error' END AS error_type FROM parsed""")
def qlog_error_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qlog.classify_errors(qlog.parse_errors(_log(spark, sf_dir)), retries="tries").select(
        "event_id", "retryable", "error_type")


@query("qlog_failure_rates", _LOG + """
SELECT failure_step, found_in_vector, need_rewrite, count(*) AS n FROM log GROUP BY ALL""")
def qlog_failure_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qlog.failure_rates(_log(spark, sf_dir))


@query("stage_durations", """
SELECT event_id, round(value / 3, 3) AS embedding, CASE WHEN event_type = 'error' THEN NULL ELSE round(value / 7, 3) END AS execution
FROM events""")
def stage_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        "event_id", (F.col("value") / 3).alias("embedding"),
        F.when(F.col("event_type") == "error", -1.0).otherwise(F.col("value") / 7).alias("execution"))
    return qlog.stage_durations(rows, ["embedding", "execution"])


# ------------------------------------------------------------ result shaping

def _result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result frame the way it arrives: everything is text."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.get_json_object("props", "$.k").alias("k"), F.col("value").cast("string").alias("value"),
        F.col("event_type").alias("name"),
        F.when(F.col("event_id") == 3, "unknown").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("mixed"))


@query("coerce_types", """
SELECT event_id, date_trunc('day', ts)::TIMESTAMP AS day, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value,
       event_type AS name, CASE WHEN event_id = 3 THEN 'unknown' ELSE strftime(ts, '%Y-%m-%d') END AS mixed FROM events""")
def coerce_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = shape.coerce_types(_result(spark, sf_dir))
    return typed.withColumn("day", F.col("day").cast("timestamp_ntz"))


_TYPES = ["click", "error", "purchase", "signup", "view"]


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.to_date("ts").alias("day"), "event_type",
                    F.when(F.col("value") >= 5, F.col("value")).alias("value"),
                    F.get_json_object("props", "$.k").cast("long").alias("k"))


def _rounded(pivoted: DataFrame) -> DataFrame:
    others = [F.round(F.col(f"`{c}`"), 6).alias(c) for c in pivoted.columns if c != "day"]
    return pivoted.select(F.col("day").cast("timestamp_ntz").alias("day"), *others)


_MEAN = "round(avg(CASE WHEN value >= 5 THEN value ELSE 0 END) FILTER (event_type = '{t}'), 6)"
_MEAN_K = "round(avg(CAST(json_extract_string(props, '$.k') AS BIGINT)) FILTER (event_type = '{t}'), 6)"


@query("chart_pivot", "SELECT date_trunc('day', ts)::TIMESTAMP AS day, "
       + ", ".join(f"{_MEAN.format(t=t)} AS {t}" for t in _TYPES) + " FROM events GROUP BY 1")
def chart_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(shape.to_chart(_series(spark, sf_dir).drop("k"))[0])


@query("chart_pivot_decimal", "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type AS category, "
       "round(avg(CASE WHEN value >= 5 THEN CAST(CAST(value AS DECIMAL(12,2)) AS DOUBLE) ELSE 0 END), 6) AS value, "
       "round(avg(CAST(json_extract_string(props, '$.k') AS INTEGER)), 6) AS k FROM events GROUP BY 1, 2")
def chart_pivot_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-point and whole numbers next to each other, as rows instead of columns."""
    rows = _series(spark, sf_dir).withColumns({"value": F.col("value").cast("decimal(12,2)"), "k": F.col("k").cast("int")})
    tall = shape.to_chart(shape.coerce_types(rows), wide=False)[0]
    return tall.select(F.col("day").cast("timestamp_ntz").alias("day"), "category", F.round("value", 6).alias("value"),
                       F.round("k", 6).alias("k"))


@query("rounded_prices", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_quantity / 2) AS BIGINT) AS halves "
       "FROM lineitem")
def rounded_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rounding cast: halves go away from zero."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                                   round_half_away(F.col("l_quantity") / 2).alias("halves"))


@query("uuid_ids", "SELECT count(*) AS n, count(*) AS n_ids, 36 AS characters FROM orders")
def uuid_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random id per row: all different, all of one length."""
    ids = table(spark, sf_dir, "orders").select(F.expr("uuid()").alias("id"))
    return ids.groupBy("id").agg(F.count(F.lit(1)).alias("c")).agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_ids"), F.max(F.length("id")).alias("characters"))


@query("chart_pivot_multi", "SELECT date_trunc('day', ts)::TIMESTAMP AS day, "
       + ", ".join(f"{_MEAN.format(t=t)} AS {t}_value, {_MEAN_K.format(t=t)} AS {t}_k" for t in _TYPES)
       + " FROM events GROUP BY 1")
def chart_pivot_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(shape.to_chart(_series(spark, sf_dir))[0])


@query("result_kind", """
SELECT 'total' AS name, 1 AS n_rows, 'audience' AS kind
UNION ALL SELECT 'per day', count(DISTINCT CAST(ts AS DATE)), 'series' FROM events
UNION ALL SELECT 'per type', count(DISTINCT event_type), 'table' FROM events""")
def result_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _series(spark, sf_dir)
    value = F.avg("value").alias("value")
    frames = {"total": rows.agg(value), "per day": rows.groupBy("day").agg(value), "per type": rows.groupBy("event_type").agg(value)}
    out = None
    for name, frame in frames.items():
        kind = shape.result_kind(frame).select(F.lit(name).alias("name"), "n_rows", "kind")
        out = kind if out is None else out.union(kind)
    return out


@query("result_cap", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 100")
def result_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capped(table(spark, sf_dir, "events").select("event_id", "value").orderBy(F.desc("value"), "event_id"))


# ------------------------------------------------------------------ functions

@query("clean_sql_text", """
SELECT conv_id, turn, regexp_replace(replace(replace(replace(replace(
  '```sql ' || text || chr(10) || '  json```', 'sql', ''), '```', ''), 'json', ''), chr(10), ' '), ' +', ' ', 'g') AS cleaned
FROM conversations""")
def clean_sql_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = F.concat(F.lit("```sql "), "text", F.lit("\n  json```"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", one_line(strip_fences(reply)).alias("cleaned"))


@query("udf_rand_date", "SELECT c_custkey, TRUE AS in_range, TRUE AS sql_in_range FROM customer")
def udf_rand_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As a column and as a SQL function; random, so only the range is checked."""
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION rand_date(low DATE, high DATE) RETURNS TIMESTAMP
        NOT DETERMINISTIC RETURN timestamp_seconds(CAST(round(unix_seconds(CAST(low AS TIMESTAMP))
        + rand() * (unix_seconds(CAST(high AS TIMESTAMP)) - unix_seconds(CAST(low AS TIMESTAMP)))) AS BIGINT))""")
    low, high = F.lit("2020-01-01").cast("date"), F.lit("2023-01-01").cast("date")
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", rand_date("2020-01-01", "2023-01-01", seed=11).alias("a"),
        F.expr("rand_date(DATE '2020-01-01', DATE '2023-01-01')").alias("b"))
    return rows.select("c_custkey", F.col("a").between(low, high).alias("in_range"),
                       F.col("b").between(low, high).alias("sql_in_range"))


@query("array_range_pick", """
SELECT c_custkey, n, ['Search', 'Organic', 'Email', 'Facebook', 'Display'][(c_custkey + n) % 5 + 1] AS source
FROM (SELECT c_custkey, unnest(generate_series(1, c_custkey % 16)) AS n FROM customer)""")
def array_range_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0 to 15 numbered sessions per user, each with a source out of a list."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.explode(number_range(F.col("c_custkey") % 16)).alias("n"))
    return rows.select("c_custkey", "n", pick(demo.TRAFFIC_SOURCES, F.col("c_custkey") + F.col("n")).alias("source"))


@query("sql_parameters", """
SELECT o_orderpriority, count(*) AS n, (SELECT count(DISTINCT o_custkey) FROM orders) AS n_users FROM orders
WHERE o_orderdate >= TIMESTAMP '1999-01-01' AND o_orderdate < TIMESTAMP '2000-01-01' GROUP BY o_orderpriority""")
def sql_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script with parameters; its variable is a scalar subquery."""
    return spark.sql("""
        SELECT o_orderpriority, count(*) AS n, (SELECT count(DISTINCT o_custkey) FROM {orders}) AS n_users
        FROM {orders} WHERE o_orderdate >= :since AND o_orderdate < :until GROUP BY o_orderpriority""",
        args={"since": dt.date(1999, 1, 1), "until": dt.date(2000, 1, 1)}, orders=table(spark, sf_dir, "orders"))
