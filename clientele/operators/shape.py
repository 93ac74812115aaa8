"""Result frames: column types, charts, kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

SEPARATOR = " / "


def _date(column: str) -> Column:
    return F.try_to_date(F.col(column), "yyyy-M-d")


def coerce_types(df: DataFrame) -> DataFrame:
    """Retype text columns whose values all read as dates or all as numbers, and
    fixed-point columns to floating point.

    One aggregation decides for all columns together; it brings back one row."""
    df = df.select(*[F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
                     for f in df.schema.fields])
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not names:
        return df

    def all_read(column: str, value: Column) -> Column:
        return F.coalesce(F.bool_and(F.col(column).isNull() | value.isNotNull()), F.lit(True))

    tests = []
    for i, name in enumerate(names):
        text = F.col(name)
        tests += [all_read(name, _date(name)).alias(f"d{i}"), all_read(name, text.try_cast("bigint")).alias(f"i{i}"),
                  all_read(name, text.try_cast("double")).alias(f"n{i}")]
    verdict = df.agg(*tests).first()
    out = []
    for name in df.columns:
        value = F.col(name)
        if name in names:
            i = names.index(name)
            if verdict[f"d{i}"]:
                value = _date(name)
            elif verdict[f"i{i}"]:
                value = value.try_cast("bigint")
            elif verdict[f"n{i}"]:
                value = value.try_cast("double")
        out.append(value.alias(name))
    return df.select(*out)


def _roles(df: DataFrame) -> tuple[list[str], list[str], list[str]]:
    dates = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DateType)]
    values = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    return dates, values, [c for c in df.columns if c not in dates + values]


def to_chart(df: DataFrame, wide: bool = True) -> tuple[DataFrame, bool]:
    """Pivot a frame with exactly one date column: dates down, categories across,
    mean of the numbers (missing numbers count as 0). Returns the frame and
    whether it is a chart, i.e. has just one number column.

    The categories become columns, so they are listed first. With `wide` = False the
    same means come as (date, category) rows; the form never depends on the data."""
    dates, values, categories = _roles(df)
    if len(dates) != 1:
        return df, False
    day, single = dates[0], len(values) == 1
    rows = df.fillna(0, subset=values) if values else df
    rows = rows.where(F.col(day).isNotNull())
    means = [F.avg(v).alias(v) for v in values]
    if not categories or not values:
        return rows.groupBy(day).agg(*means), single
    for c in categories:
        rows = rows.where(F.col(c).isNotNull())
    rows = rows.withColumn("_category", F.concat_ws(SEPARATOR, *categories))
    if not wide:
        return rows.groupBy(day, F.col("_category").alias("category")).agg(*means), single
    found = rows.select("_category").distinct().orderBy("_category").collect()
    return rows.groupBy(day).pivot("_category", [r[0] for r in found]).agg(*means), single


def result_kind(df: DataFrame) -> DataFrame:
    """One row: (n_rows, kind). A single row is an audience; one date column makes
    a series, anything else is a table."""
    dates, values, _ = _roles(df)
    shape = "series" if len(dates) == 1 and len(values) == 1 else "table"
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "kind", F.when(F.col("n_rows") == 1, "audience").otherwise(shape))
