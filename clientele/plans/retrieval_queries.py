"""Registered queries: similarity search and the corpus of known questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clientele.operators import buckets, corpus as corp
from clientele.operators.similarity import similar, similar_lsh
from clientele.operators.text_vectors import term_weights, vectors
from clientele.plans.registry import query
from clientele.session import scratch_dir
from clientele.sources.demo import table

# How many examples and tables are retrieved, and from which similarity on.
EXAMPLES, TABLES, THRESHOLD = 3, 5, 0.1
ROUTE_THRESHOLD = 0.4
TABLE_NAMES = ["user_aggregates", "product_aggregates"]

# Every vector is asked against all the others. Same text in both engines.
_SIM = {"cosine": "list_cosine_similarity(a.v, b.v)", "ip": "list_inner_product(a.v, b.v)",
        "l2": "-list_distance(a.v, b.v)"}


def _knn_sql(body: str, k: int, metric: str = "cosine", threshold: float | None = THRESHOLD, same: str = "TRUE") -> str:
    above = "TRUE" if threshold is None else f"s > {threshold}"
    return f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
pairs AS (SELECT a.vec_id AS qid, b.vec_id AS id, a.label AS q_label, b.label AS v_label,
                 round({_SIM[metric]}, 9) AS s FROM e a JOIN e b ON a.vec_id <> b.vec_id AND {same}),
top AS (SELECT qid, id, q_label, v_label, s, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rank
        FROM pairs WHERE {above} QUALIFY rank <= {k})
{body}"""


_KNN = "SELECT qid, id, round(s, 6) AS similarity, CAST(rank AS INT) AS rank FROM top"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings")
    return (e.select(F.col("vec_id").alias("qid"), "embedding", "label"),
            e.select(F.col("vec_id").alias("id"), "embedding", "label"))


def _knn(spark: SparkSession, sf_dir: str, k: int, threshold: float | None = THRESHOLD, **options) -> DataFrame:
    asked, stored = _sides(spark, sf_dir)
    return similar(asked, stored, k, threshold, exclude_same_id=True, **options)


def _shown(found: DataFrame) -> DataFrame:
    return found.select("qid", "id", F.round("similarity", 6).alias("similarity"), "rank")


@query("knn_examples", _knn_sql(_KNN, EXAMPLES))
def knn_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_knn(spark, sf_dir, EXAMPLES))


@query("knn_blocks", _knn_sql(_KNN, EXAMPLES))
def knn_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan for many queries: block against block."""
    return _shown(_knn(spark, sf_dir, EXAMPLES, strategy="blocks", block_rows=200))


@query("knn_l2", _knn_sql(_KNN, EXAMPLES, "l2", None))
def knn_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_knn(spark, sf_dir, EXAMPLES, None, metric="l2"))


@query("knn_ip", _knn_sql(_KNN, EXAMPLES, "ip", None))
def knn_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_knn(spark, sf_dir, EXAMPLES, None, metric="ip"))


@query("knn_prefilter", _knn_sql(_KNN, EXAMPLES, same="a.label = b.label"))
def knn_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_knn(spark, sf_dir, EXAMPLES, pre_filter=["label"]))


@query("knn_prefilter_blocks", _knn_sql(_KNN, EXAMPLES, same="a.label = b.label"))
def knn_prefilter_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_knn(spark, sf_dir, EXAMPLES, pre_filter=["label"], strategy="blocks", block_rows=40))


@query("knn_postfilter", _knn_sql(_KNN + " WHERE q_label = v_label", EXAMPLES))
def knn_postfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_knn(spark, sf_dir, EXAMPLES, post_filter=["label"]))


_DESCRIPTION_SQL = """'Table: `shop.' || CASE v_label % 3 WHEN 0 THEN 'user_aggregates' WHEN 1 THEN 'product_aggregates'
  ELSE 'stock' END || '` number ' || CAST(id AS VARCHAR)"""


def _with_description(found: DataFrame, stored: DataFrame) -> DataFrame:
    name = (F.when(F.col("label") % 3 == 0, "user_aggregates").when(F.col("label") % 3 == 1, "product_aggregates")
            .otherwise("stock"))
    text = F.concat(F.lit("Table: `shop."), name, F.lit("` number "), F.col("id").cast("string"))
    return found.join(stored.select("id", text.alias("description")), "id")


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _knn(spark, sf_dir, TABLES)
    return corp.joined_descriptions(_with_description(found, _sides(spark, sf_dir)[1]))


_TABLES_SQL = f"SELECT qid, string_agg({_DESCRIPTION_SQL}, chr(10) ORDER BY rank) AS descriptions FROM top GROUP BY qid"


@query("knn_tables", _knn_sql(_TABLES_SQL, TABLES))
def knn_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(spark, sf_dir)


@query("matched_tables", _knn_sql(f"""
SELECT qid, concat_ws(',', CASE WHEN contains(descriptions, 'user_aggregates') THEN 'user_aggregates' END,
                           CASE WHEN contains(descriptions, 'product_aggregates') THEN 'product_aggregates' END) AS tables
FROM ({_TABLES_SQL})""", TABLES))
def matched_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(spark, sf_dir).select(
        "qid", F.array_join(corp.matched_tables(F.col("descriptions"), TABLE_NAMES), ",").alias("tables"))


@query("audience_flag", _knn_sql(
    f"SELECT qid, contains(descriptions, 'user_aggregates') AS is_audience FROM ({_TABLES_SQL})", TABLES))
def audience_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = corp.matched_tables(F.col("descriptions"), TABLE_NAMES)
    return _tables(spark, sf_dir).select("qid", F.array_contains(names, "user_aggregates").alias("is_audience"))


@query("fewshot_context", _knn_sql("""
SELECT qid, '[Good SQL Examples]:' || chr(10) || string_agg(
  '- Question:' || chr(10) || 'How many rows has t' || CAST(id AS VARCHAR) || '?' || chr(10) || '-SQL Query:' || chr(10)
  || 'SELECT count(*) FROM t' || CAST(id AS VARCHAR) || ' WHERE label = ' || CAST(v_label AS VARCHAR) || chr(10) || chr(10),
  '' ORDER BY rank) AS context FROM top GROUP BY qid""", EXAMPLES))
def fewshot_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _knn(spark, sf_dir, EXAMPLES)
    name = F.col("id").cast("string")
    stored = _sides(spark, sf_dir)[1].select(
        "id", F.concat(F.lit("How many rows has t"), name, F.lit("?")).alias("question"),
        F.concat(F.lit("SELECT  count(*)\nFROM t"), name, F.lit("\n  WHERE label =   "), F.col("label").cast("string"))
         .alias("sql_query"))
    return corp.examples_context(found.join(stored, "id"))


@query("model_route", _knn_sql("""
SELECT e.vec_id AS qid, CASE WHEN t.qid IS NULL THEN 'fine' ELSE 'fast' END AS route
FROM e LEFT JOIN (SELECT DISTINCT qid FROM top) t ON e.vec_id = t.qid""", EXAMPLES, threshold=ROUTE_THRESHOLD))
def model_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, stored = _sides(spark, sf_dir)
    return corp.model_route(asked, similar(asked, stored, EXAMPLES, ROUTE_THRESHOLD, exclude_same_id=True))


def _buckets_sql(body: str, hashes: int = 12) -> str:
    """The bucket-length search restated: `met` holds the pairs of each table that share a
    visited cell. The directions are written out; up to `hashes` of them are used, by the
    count of the corpus."""
    t = buckets.Tables(64, hashes, 0)
    directions, offsets = t.directions(), t.offsets()
    rows = ", ".join(f"({i}, {j + 1}, {directions[i, :, j].tolist()}::DOUBLE[], {float(offsets[i, j])!r}::DOUBLE)"
                     for i in range(t.tables) for j in range(hashes))
    return f"""
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM e WHERE list_inner_product(v, v) > 0),
m AS (SELECT greatest(4, CAST(floor(ln(count(*))) AS INT)) AS m FROM e),
directions(t, j, d, o) AS (VALUES {rows}),
p AS (SELECT vec_id, t, j, list_inner_product(v, d) / {t.length}::DOUBLE + o AS p FROM u, directions, m WHERE j <= m),
c AS (SELECT vec_id, t, list(CAST(floor(p) AS INT) ORDER BY j) AS cell FROM p GROUP BY ALL),
b AS (SELECT vec_id, t, j, -1 AS s, p - floor(p) AS far FROM p UNION ALL SELECT vec_id, t, j, 1, 1 - (p - floor(p)) FROM p),
o AS (SELECT vec_id, t, list({{'j': j, 's': s}} ORDER BY far, s, j) AS borders FROM b GROUP BY ALL),
cost AS (SELECT j, CASE WHEN j <= m THEN j * (j + 1)
                   ELSE 4 * (m + 1) * (m + 2) - 4 * (m + 2) * (2 * m + 1 - j) + (2 * m + 1 - j) * (2 * m + 2 - j) END AS cost
         FROM m, range(1, 2 * m + 1) r(j)),
sets AS (SELECT []::BIGINT[] AS s, 0::BIGINT AS cost UNION ALL
         SELECT list_append(s, j), sets.cost + cost.cost FROM sets, cost, m
         WHERE len(s) < least({buckets.CROSSED}, m) AND (len(s) = 0 OR j > s[-1]) AND NOT list_contains(s, 2 * m + 1 - j)),
chosen AS (SELECT s FROM sets ORDER BY cost, len(s), s LIMIT (SELECT CAST(floor(7 * 1.6 ** m) AS BIGINT) FROM m)),
visits AS (SELECT vec_id, t, list_transform(cell, lambda x, i: CAST(x + coalesce(list_sum(list_transform(s,
             lambda k: CASE WHEN borders[k].j = i THEN borders[k].s ELSE 0 END)), 0) AS INT)) AS cell
           FROM c JOIN o USING (vec_id, t), chosen),
met AS (SELECT t, q.vec_id AS qid, x.vec_id AS id FROM (SELECT DISTINCT * FROM visits) q JOIN c x USING (t, cell)),
scored AS (SELECT qid, id, round(list_cosine_similarity(a.v, b.v), 9) AS s FROM (SELECT DISTINCT qid, id FROM met WHERE qid <> id)
           JOIN e a ON a.vec_id = qid JOIN e b ON b.vec_id = id),
top AS (SELECT qid, id, s, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rank FROM scored
        WHERE s > {THRESHOLD} QUALIFY rank <= {EXAMPLES})
{body}"""


@query("knn_lsh", _buckets_sql(_KNN))
def knn_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, stored = _sides(spark, sf_dir)
    return _shown(similar_lsh(asked, stored, EXAMPLES, THRESHOLD, exclude_same_id=True))


@query("knn_lsh_recall", _buckets_sql(f""",
pairs AS (SELECT a.vec_id AS qid, b.vec_id AS id, round(list_cosine_similarity(a.v, b.v), 9) AS s FROM e a JOIN e b ON a.vec_id <> b.vec_id),
exact AS (SELECT qid, id FROM pairs WHERE s > {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) <= {EXAMPLES})
SELECT count(*) AS wanted, count(top.id) AS found, count(top.id) >= 0.9 * count(*) AS enough,
       (SELECT count(*) FROM met) AS compared FROM exact LEFT JOIN top USING (qid, id)"""))
def knn_lsh_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the three nearest the approximate search finds, and what it compares."""
    asked, stored = _sides(spark, sf_dir)
    found = buckets.search_corpus(asked, stored, EXAMPLES, THRESHOLD, exclude_same_id=True)
    near = found.where(F.col("qid").isNotNull()).select("qid", "id").distinct().withColumn("hit", F.lit(1))
    exact = similar(asked, stored, EXAMPLES, THRESHOLD, exclude_same_id=True, strategy="blocks").select("qid", "id")
    counts = exact.join(near, ["qid", "id"], "left").agg(F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("found"))
    pairs = found.agg(F.coalesce(F.sum("compared"), F.lit(0)).alias("compared"))
    return counts.withColumn("enough", F.col("found") >= 0.9 * F.col("wanted")).withColumn("compared", pairs.scalar())


# ------------------------------------------------------ questions and answers

_PARTS = "'shop.warehouse.' || role || '.cdp.' || text || '.Y'"
_STORED_SQL = """
SELECT md5('shop.warehouse.user.cdp.' || text || '.Y') AS id, text AS question,
       'SELECT ' || CAST(item_id AS VARCHAR) || ' ' AS generated_sql FROM benchmark"""


def _as_questions(df: DataFrame, text: str, requestor, sql) -> DataFrame:
    return df.select(
        F.col(text).alias("question"), sql.alias("generated_sql"), requestor.alias("requestor"),
        F.lit("shop").alias("table_catalog"), F.lit("cdp").alias("table_schema"), F.lit("warehouse").alias("source_type"),
        *[c for c in ("conv_id", "turn", "item_id") if c in df.columns])


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    sql = F.concat(F.lit("SELECT "), F.col("item_id").cast("string"))
    return corp.new_entries(_as_questions(b, "text", F.lit("user"), sql)).drop("item_id")


def _spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    sql = F.concat(F.lit("SELECT conv "), F.col("conv_id").cast("string"))
    return corp.new_entries(_as_questions(c, "text", F.col("role"), sql))


@query("lookup_by_hash", f"""
WITH stored AS ({_STORED_SQL}),
asked AS (SELECT text, 'user' AS requestor, md5('shop.warehouse.user.cdp.' || text || '.Y') AS id FROM benchmark
          UNION ALL SELECT text, role, md5({_PARTS}) FROM conversations)
SELECT a.text AS question, a.requestor, coalesce(s.generated_sql, 'SQL Not Found in Vector DB') AS generated_sql
FROM asked a LEFT JOIN stored s ON a.id = s.id AND a.requestor = 'user'""")
def lookup_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _stored(spark, sf_dir)
    columns = ["id", "question", "requestor"]
    asked = stored.select(*columns).unionByName(_spoken(spark, sf_dir).select(*columns))
    return corp.lookup(asked, stored).select("question", "requestor", "generated_sql")


@query("sql_corpus_upsert", f"""
WITH stored AS ({_STORED_SQL}),
batch AS (SELECT md5({_PARTS}) AS id, text AS question, 'SELECT conv ' || CAST(conv_id AS VARCHAR) || ' ' AS generated_sql,
                 conv_id, turn FROM conversations
          UNION ALL SELECT id, question, 'again', -1, item_id FROM stored JOIN benchmark ON question = text)
SELECT id, question, generated_sql FROM stored
UNION ALL
SELECT id, question, generated_sql FROM batch WHERE id NOT IN (SELECT id FROM stored)
QUALIFY row_number() OVER (PARTITION BY id ORDER BY conv_id, turn) = 1""")
def sql_corpus_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations and, once more, everything stored already: copies are ignored."""
    stored = _stored(spark, sf_dir).select("id", "question", "generated_sql")
    again = stored.select("id", "question", F.lit("again").alias("generated_sql"), F.lit(-1).cast("long").alias("conv_id"),
                          F.lit(0).cast("long").alias("turn"))
    batch = _spoken(spark, sf_dir).select("id", "question", "generated_sql", "conv_id", "turn").unionByName(again)
    return corp.upsert_ignore(stored, batch, "id", ["conv_id", "turn"])


@query("sql_corpus_store", f"""
WITH stored AS ({_STORED_SQL}),
batch AS (SELECT md5({_PARTS}) AS id, text AS question, 'SELECT conv ' || CAST(conv_id AS VARCHAR) || ' ' AS generated_sql,
                 conv_id, turn FROM conversations)
SELECT id, question, generated_sql FROM stored
UNION ALL
SELECT id, question, generated_sql FROM batch WHERE id NOT IN (SELECT id FROM stored)
QUALIFY row_number() OVER (PARTITION BY id ORDER BY conv_id, turn) = 1""")
def sql_corpus_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as a stored table: created by the first call, then only new ids are
    appended; storing the same batch once more adds nothing."""
    path = scratch_dir(spark, "sql-corpus")
    columns = ["id", "question", "generated_sql", "conv_id", "turn"]
    first = _stored(spark, sf_dir).withColumns({"conv_id": F.lit(-1).cast("long"), "turn": F.lit(0).cast("long")})
    batch = _spoken(spark, sf_dir).select(*columns)
    for rows in (first.select(*columns), batch, batch):
        stored = corp.store_new(rows, path, "id", ["conv_id", "turn"])
    return stored.select("id", "question", "generated_sql")


@query("table_text_store", """
WITH t AS (SELECT 'shop' AS table_catalog, 'warehouse' AS source_type, o_orderpriority AS requestor, 'cdp' AS table_schema,
                  'order_' || CAST(o_orderkey AS VARCHAR) AS table_name, 'Order in state ' || o_orderstatus AS detailed_description
           FROM orders)
SELECT DISTINCT md5(table_catalog || '.' || source_type || '.' || requestor || '.' || table_schema || '.' || table_name || '.'
           || detailed_description) AS id, table_name, detailed_description FROM t""")
def table_text_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions of tables stored under the id of their content; half of them come
    twice."""
    path, name = scratch_dir(spark, "table-texts"), F.concat(F.lit("order_"), F.col("o_orderkey").cast("string"))
    texts = corp.table_texts(table(spark, sf_dir, "orders").select(
        F.lit("shop").alias("table_catalog"), F.lit("warehouse").alias("source_type"), F.col("o_orderpriority").alias("requestor"),
        F.lit("cdp").alias("table_schema"), name.alias("table_name"),
        F.concat(F.lit("Order in state "), "o_orderstatus").alias("detailed_description")))
    for part in (texts.where("requestor < '3'"), texts):
        stored = corp.store_new(part, path, "id", ["table_name"])
    return stored.select("id", "table_name", "detailed_description")


@query("uninitialized_tables", """
SELECT c_mktsegment AS table_schema, 't' || CAST(c_custkey AS VARCHAR) AS table_name FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')""")
def uninitialized_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables (here: customers) without a stored description (an urgent order)."""
    on = ["requestor", "table_catalog", "table_schema", "table_name"]
    named = table(spark, sf_dir, "customer").select(
        F.lit("user").alias("requestor"), F.lit("shop").alias("table_catalog"),
        F.col("c_mktsegment").alias("table_schema"),
        F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("table_name"), "c_custkey")
    urgent = table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "1-URGENT").select("o_custkey").distinct()
    stored = named.join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    return corp.missing_keys(named, stored, on).select("table_schema", "table_name")


# ----------------------------------------------------------------- text vectors

_TFIDF = """
WITH texts AS ({texts}),
words AS (SELECT k, unnest(string_split_regex(lower(text), '[ \\n\\t]+')) AS w FROM texts),
tf AS (SELECT k, CAST(('0x' || substr(md5(w), 1, 8)) AS BIGINT) % 64 AS dimension, count(*) AS tf
       FROM words WHERE w <> '' GROUP BY ALL),
df AS (SELECT dimension, ln((SELECT count(*) + 1.0::DOUBLE FROM texts) / (count(*) + 1)) AS idf FROM tf GROUP BY dimension),
raw AS (SELECT k, dimension, tf * idf AS raw FROM tf JOIN df USING (dimension)),
norm AS (SELECT k, sqrt(sum(raw * raw)) AS norm FROM raw GROUP BY k),
weights AS (SELECT k, dimension, raw / norm AS weight FROM raw JOIN norm USING (k) WHERE norm > 0)
"""


@query("text_embed_tfidf", _TFIDF.format(texts="SELECT doc_id AS k, text FROM documents")
       + "SELECT k AS doc_id, CAST(dimension AS INT) AS dimension, round(weight, 5) AS weight FROM weights")
def text_embed_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = term_weights(table(spark, sf_dir, "documents"), "doc_id", "text")
    return weights.select("doc_id", "dimension", F.round("weight", 5).alias("weight"))


@query("knn_text", _TFIDF.format(texts="""
  SELECT 'd' || CAST(doc_id AS VARCHAR) AS k, text FROM documents
  UNION ALL SELECT 'b' || CAST(item_id AS VARCHAR), text FROM benchmark""") + f""",
w AS (SELECT k, dimension, CAST(CAST(weight AS FLOAT) AS DOUBLE) AS weight FROM weights),
size AS (SELECT k, sqrt(sum(weight * weight)) AS size FROM w GROUP BY k),
pairs AS (SELECT a.k AS qid, b.k AS id, sum(a.weight * b.weight) AS dot FROM w a JOIN w b USING (dimension)
          WHERE a.k LIKE 'b%' AND b.k LIKE 'd%' GROUP BY a.k, b.k),
scored AS (SELECT qid, id, round(dot / (x.size * y.size), 9) AS s FROM pairs JOIN size x ON qid = x.k JOIN size y ON id = y.k)
SELECT qid, id, round(s, 6) AS similarity, CAST(row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS INT) AS rank
FROM scored WHERE s > {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) <= {EXAMPLES}""")
def knn_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents most similar to each benchmark text, over TF-IDF vectors."""
    texts = (table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("k"), "text")
             .union(table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")), "text")))
    path = scratch_dir(spark, "text-vectors")       # the vectors serve both sides
    vectors(term_weights(texts, "k", "text"), "k").write.parquet(path)
    embedded = spark.read.parquet(path)
    asked = embedded.where(F.col("k").startswith("b")).select(F.col("k").alias("qid"), "embedding")
    stored = embedded.where(F.col("k").startswith("d")).select(F.col("k").alias("id"), "embedding")
    return _shown(similar(asked, stored, EXAMPLES, THRESHOLD))
