"""Scoring of JSON replies that explain how a query implements its filters.

Everything about one reply happens inside its row (array functions), so scoring
needs no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The flag is read as text: a reply may hold true, false or something else, and
# only a real false (or 0) counts as "not relevant".
REPLY_SCHEMA = (
    "filters array<struct<name string, classification string, "
    "columns array<struct<name string, scope string, is_relevant string>>>>, "
    "reversed_question string, _bad string")

# The verdict for unreadable replies and the two messages.
MALFORMED = "Returned JSON malformed"
WRONG_SCOPE = ("- \"", "\" is implemented using column '", "' with scope '", "'. Use a column with scope '", "' instead.\n")
NOT_RELEVANT = ("- The column '", "' is either not relevant or not used correctly to implement the filter '", "'.\n")


def _message(parts: tuple[str, ...], *values: Column) -> Column:
    pieces = [F.lit(parts[0])]
    for value, part in zip(values, parts[1:]):
        pieces += [value, F.lit(part)]
    return F.concat(*pieces)


def parse_replies(replies: DataFrame, raw: str = "reply") -> DataFrame:
    """Adds the parsed `filters` and `reversed_question`, and `malformed`.

    A reply must be a JSON object with both parts, and every filter needs its
    name, classification and columns. Control characters inside strings pass."""
    parsed = F.from_json(F.col(raw), REPLY_SCHEMA, {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "allowUnquotedControlChars": "true"})
    out = replies.withColumn("_p", parsed)
    incomplete = F.exists(F.col("_p.filters"), lambda f: (
        f["name"].isNull() | f["classification"].isNull() | f["columns"].isNull()
        | F.exists(f["columns"], lambda c: c["name"].isNull() | c["scope"].isNull())))
    broken = (F.col("_p").isNull() | F.col("_p._bad").isNotNull() | F.col("_p.filters").isNull()
              | F.col("_p.reversed_question").isNull() | incomplete)
    malformed = F.coalesce(broken, F.lit(True))
    return (out.withColumn("malformed", malformed)
               .withColumn("filters", F.when(~F.col("malformed"), F.col("_p.filters")))
               .withColumn("reversed_question", F.when(~F.col("malformed"), F.col("_p.reversed_question")))
               .drop("_p"))


def scope_mismatch(classification: Column, scope: Column) -> Column:
    """A column fits a filter if its scope is 'both' or the filter's class."""
    return (scope != "both") & (scope != classification)


def _not_relevant(column: Column) -> Column:
    return F.coalesce(F.lower(column["is_relevant"]).isin("false", "0"), F.lit(False))


def _messages(filters: Column) -> Column:
    """All messages of a reply, by filter, then column, then rule."""
    def of_column(f: Column, c: Column) -> Column:
        other = F.when(c["scope"] == "global", "time-dependent").otherwise("global")
        return F.array(
            F.when(scope_mismatch(f["classification"], c["scope"]),
                   _message(WRONG_SCOPE, f["name"], c["name"], c["scope"], other)),
            F.when(_not_relevant(c), _message(NOT_RELEVANT, c["name"], f["name"])))

    per_filter = F.transform(filters, lambda f: F.flatten(F.transform(f["columns"], lambda c: of_column(f, c))))
    return F.filter(F.flatten(per_filter), lambda m: m.isNotNull())


def score_validation(replies: DataFrame, raw: str = "reply") -> DataFrame:
    """Adds is_matching, mismatch_details and reversed_question to every reply."""
    details = (F.when(F.col("malformed"), MALFORMED)
               .otherwise(F.array_join(_messages(F.col("filters")), "")))
    return (parse_replies(replies, raw).withColumn("mismatch_details", details)
            .withColumn("is_matching", F.col("mismatch_details") == "").drop("malformed", "filters"))


def filter_columns(replies: DataFrame, key: str, raw: str = "reply") -> DataFrame:
    """One row per filter and column of the well-formed replies."""
    rows = parse_replies(replies, raw).where(~F.col("malformed"))
    return (rows.select(key, F.posexplode("filters").alias("f_pos", "f"))
            .select(key, "f_pos", F.col("f.name").alias("filter_name"), "f.classification",
                    F.posexplode("f.columns").alias("c_pos", "c"))
            .select(key, "f_pos", "c_pos", "filter_name", "classification", F.col("c.name").alias("column_name"),
                    "c.scope", (~_not_relevant(F.col("c"))).alias("is_relevant")))


def mismatches(columns: DataFrame) -> DataFrame:
    """Rows of `filter_columns` that break a rule, with the rules they break."""
    rules = F.filter(F.array(
        F.when(scope_mismatch(F.col("classification"), F.col("scope")), "scope"),
        F.when(~F.col("is_relevant"), "relevance")), lambda r: r.isNotNull())
    return columns.withColumn("rule", F.explode(rules))


def scope_lookup(columns: DataFrame, fields: DataFrame) -> DataFrame:
    """Scopes out of the catalogue instead of the reply.

    `fields` is a catalogue frame (field_path, scope). Unknown columns keep NULL."""
    known = fields.select(F.col("field_path").alias("column_name"), F.col("scope").alias("catalog_scope")).distinct()
    return (columns.join(known, "column_name", "left")
            .withColumn("fits", ~scope_mismatch(F.col("classification"), F.col("catalog_scope"))))
