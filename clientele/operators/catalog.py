"""Catalogue of tables: fields, keys and one description text per table.

Inputs are frames shaped like information-schema views:

columns      project_id, owner, table_name, column_name, is_nullable
field_paths  project_id, owner, table_name, column_name, field_path, data_type, description
constraints  constraint_name, project_id, owner, table_name, constraint_type
key_usage    constraint_name, column_name [, r_owner, r_table_name, r_column_name]
tables       project_id, owner, table_name, comments
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from clientele.functions.text import first_match, unquote

TABLE_KEY = ["project_id", "owner", "table_name"]

# Line separators inside a description text.
COLUMN_SEPARATOR = " \n  "
FK_INDENT = "\n      "


def schema_fields(spark: SparkSession, project: str, owner: str, schemas: dict[str, T.StructType]) -> DataFrame:
    """Field paths of tables known by schema; nested fields as `parent.child`."""
    def walk(table: str, top: str, prefix: str, struct: T.StructType) -> Iterable[tuple]:
        for field in struct.fields:
            path, kind = prefix + field.name, field.dataType
            yield (project, owner, table, top or field.name, path, kind.simpleString(), field.nullable,
                   field.metadata.get("comment"), field.metadata.get("scope"))
            inner = kind.elementType if isinstance(kind, T.ArrayType) else kind
            if isinstance(inner, T.StructType):
                yield from walk(table, top or field.name, path + ".", inner)

    rows = [row for table, schema in schemas.items() for row in walk(table, "", "", schema)]
    return spark.createDataFrame(rows, "project_id string, owner string, table_name string, column_name string, "
                                       "field_path string, data_type string, is_nullable boolean, "
                                       "description string, scope string")


def listed(names: list[str] | None, table: Column | None = None) -> Column:
    """Keep the configured tables; an empty list keeps all."""
    return (F.col("table_name") if table is None else table).isin(names) if names else F.lit(True)


def scope_of(description: Column) -> Column:
    """Scope named at the end of a column comment; NULL when there is none."""
    return first_match(description, "Scope: (time-dependent|global|both)")


def in_order(rows: DataFrame, *last: str) -> DataFrame:
    """Catalogue rows by project, owner and table, then by further columns."""
    return rows.orderBy(*[c for c in TABLE_KEY if c in rows.columns], *last)


def own_tables(spark: SparkSession, project: str, owner: str, schemas: dict[str, T.StructType],
               comments: dict[str, str]) -> DataFrame:
    """Field paths of tables known by schema, with the comment of the table, in order."""
    texts = spark.createDataFrame(list(comments.items()), "table_name string, table_comment string")
    return in_order(schema_fields(spark, project, owner, schemas).join(F.broadcast(texts), "table_name", "left"),
                    "column_name", "field_path")


def catalog_fields(columns: DataFrame, field_paths: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Columns with all their field paths."""
    on = [*TABLE_KEY, "column_name"]
    return (columns.where(listed(names)).join(field_paths, on)
            .select(*on, "field_path", "data_type", "is_nullable", "description",
                    scope_of(F.col("description")).alias("scope")))


def catalog_keys(constraints: DataFrame, key_usage: DataFrame, kind: str, names: list[str] | None = None) -> DataFrame:
    """Key columns of one kind, 'PRIMARY KEY' or 'FOREIGN KEY'; see `in_order`."""
    return (constraints.where((F.col("constraint_type") == kind) & listed(names))
            .join(key_usage, "constraint_name"))


def table_comments(options: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Comments without the quotes the option value comes in."""
    return options.where((F.col("option_name") == "description") & listed(names)).select(
        *TABLE_KEY, unquote(F.col("option_value")).alias("comments"))


def _texts(rows: DataFrame, on: list[str], order: list[str], more: list[str], text: Callable[[Column], Column], sep: str,
           name: str) -> DataFrame:
    """One ordered text per table, of a line per row; `more`: what a line says besides its order.
    The number of rows is the width of a table. Rows move by the name of their table, as the
    tables do, and lines are made where they have come together."""
    got = rows.repartition("table_name").groupBy(*on).agg(F.collect_list(F.struct(*order, *more)).alias("_p"))
    lines = F.transform("_p", lambda row: F.struct(*[row[c].alias(c) for c in order], text(row).alias("_t")))
    return got.withColumn("_p", F.sort_array(lines)).select(*on, F.array_join("_p._t", sep).alias(name))


def table_descriptions(tables: DataFrame, fields: DataFrame, primary: DataFrame, foreign: DataFrame) -> DataFrame:
    """(project_id, owner, table_name, detailed_description) for every table."""
    def owned(rows: DataFrame) -> list[str]:
        # keys listed for a single project may come without its name
        return [c for c in TABLE_KEY if c in rows.columns]

    def column(row: Column) -> Column:
        return F.concat(F.lit("- "), row["field_path"], F.lit(" ("), row["data_type"], F.lit(") - "),
                        F.coalesce(row["description"], F.lit("")))

    def reference(row: Column) -> Column:
        return F.concat(
            F.lit(f"{FK_INDENT}Column "), row["column_name"], F.lit(" is equal to column "), row["r_column_name"],
            F.lit(" in table "), row["r_owner"], F.lit("."), row["r_table_name"], F.lit(FK_INDENT))

    cols = _texts(fields, owned(fields), ["column_name", "field_path"], ["data_type", "description"], column, COLUMN_SEPARATOR, "_columns")
    pks = _texts(primary, owned(primary), ["column_name"], [], lambda row: row["column_name"], ",", "_pk")
    fks = _texts(foreign, owned(foreign), ["column_name", "r_owner", "r_table_name", "r_column_name"], [], reference, ",", "_fk")
    joined = tables.join(cols, owned(cols), "left").join(pks, owned(pks), "left").join(fks, owned(fks), "left")
    full = F.concat_ws(".", "project_id", "owner", "table_name")
    text = F.concat(
        F.lit("\n  Table: `"), full, F.lit("`\n  Owner: "), F.col("owner"),
        F.lit("\n  Columns:\n  "), F.coalesce("_columns", F.lit("")),
        F.lit("\n  Primary Key: "), F.coalesce("_pk", F.lit("None")),
        F.lit("\n  Foreign Keys: "), F.coalesce("_fk", F.lit("None")),
        F.lit("\n  Project_id: "), F.col("project_id"),
        F.lit("\n  Table Description: "), F.coalesce("comments", F.lit("None")))
    return joined.select(*TABLE_KEY, text.alias("detailed_description"))
