"""The corpus of questions with known answers, and the stored table texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clientele.functions.text import content_id, one_line

# The answer for an unknown question, and the frame of the examples.
NOT_FOUND = "SQL Not Found in Vector DB"
EXAMPLES_HEAD = "[Good SQL Examples]:\n"
EXAMPLE_QUESTION, EXAMPLE_SQL, EXAMPLE_END = "- Question:\n", "\n-SQL Query:\n", "\n\n"


def question_id(project: Column, source: Column, requestor: Column, schema: Column, question: Column,
                valid: Column) -> Column:
    return content_id(project, source, requestor, schema, question, valid)


def new_entries(questions: DataFrame) -> DataFrame:
    """Rows ready to store: id from the content, the SQL padded by one blank."""
    return questions.withColumn("id", question_id(
        F.col("table_catalog"), F.col("source_type"), F.col("requestor"), F.col("table_schema"), F.col("question"),
        F.lit("Y"))).withColumn("generated_sql", F.concat("generated_sql", F.lit(" ")))


def missing_keys(wanted: DataFrame, stored: DataFrame, on: list[str]) -> DataFrame:
    """Rows of `wanted` whose key is not stored."""
    return wanted.join(stored.select(*on), on, "left_anti")


def upsert_ignore(target: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Insert if absent: a stored row wins, then the first of the batch by `order`.

    The first row per key is a minimum, so copies collapse on the map side and a
    key repeated millions of times travels once per task."""
    rest = [c for c in target.columns if c != key]
    carried = F.struct(*order, *[c for c in rest if c not in order])
    first = (new.groupBy(key).agg(F.min(carried).alias("_r"))
             .select(key, *[F.col(f"_r.{c}").alias(c) for c in rest]))
    return target.select(key, *rest).unionByName(missing_keys(first, target, [key]))


def table_texts(descriptions: DataFrame) -> DataFrame:
    """Table descriptions ready to store: the id comes from catalogue, source,
    requestor, schema, table and text."""
    return descriptions.withColumn("id", content_id(
        F.col("table_catalog"), F.col("source_type"), F.col("requestor"), F.col("table_schema"), F.col("table_name"),
        F.col("detailed_description")))


def store_new(new: DataFrame, path: str, key: str, order: list[str]) -> DataFrame:
    """Append the rows whose key is not stored at `path` yet and return the table.

    Creates the table if there is none. Of several new rows with a key the first by
    `order` is stored. Stored rows are neither read whole nor written again."""
    spark = new.sparkSession
    rest = [c for c in new.columns if c != key]
    carried = F.struct(*order, *[c for c in rest if c not in order])
    first = new.groupBy(key).agg(F.min(carried).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])
    # an append of no row creates the table with its columns
    first.limit(0).write.mode("append").parquet(path)
    stored = spark.read.schema(first.schema).parquet(path)
    missing_keys(first, stored, [key]).write.mode("append").parquet(path)
    return spark.read.schema(first.schema).parquet(path)


def lookup(asked: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored SQL for questions asked word by word before.

    `asked` needs (id, requestor) made the same way; everybody gets an answer."""
    hits = stored.select("id", "requestor", "generated_sql")
    return (asked.join(hits, ["id", "requestor"], "left")
            .withColumn("generated_sql", F.coalesce("generated_sql", F.lit(NOT_FOUND))))


def examples_context(matches: DataFrame) -> DataFrame:
    """(qid, context): the matched examples of a query as one text, best first.

    Input (qid, rank, question, sql_query); at most k rows per query."""
    entry = F.concat(F.lit(EXAMPLE_QUESTION), "question", F.lit(EXAMPLE_SQL), one_line(F.col("sql_query")),
                     F.lit(EXAMPLE_END))
    rows = F.sort_array(F.collect_list(F.struct("rank", entry.alias("entry"))))
    return (matches.groupBy("qid").agg(rows.alias("_rows"))
            .select("qid", F.concat(F.lit(EXAMPLES_HEAD), F.array_join("_rows.entry", "")).alias("context")))


def joined_descriptions(matches: DataFrame) -> DataFrame:
    """(qid, descriptions): texts of the matched tables, best first, one per line."""
    rows = F.sort_array(F.collect_list(F.struct("rank", "description")))
    return (matches.groupBy("qid").agg(rows.alias("_rows"))
            .select("qid", F.array_join("_rows.description", "\n").alias("descriptions")))


def matched_tables(text: Column, names: list[str]) -> Column:
    """Configured table names that occur in the text, in configured order."""
    return F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(text, n))


def model_route(questions: DataFrame, matches: DataFrame) -> DataFrame:
    """(qid, route): 'fast' if an example was found, else 'fine'."""
    found = matches.select("qid").distinct().withColumn("_hit", F.lit(True))
    return questions.select("qid").join(found, "qid", "left").select(
        "qid", F.when(F.col("_hit"), "fast").otherwise("fine").alias("route"))
