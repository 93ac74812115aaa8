"""User history that takes in new days without a rebuild.

Four tables: `days` and `marks`, a folder for each day (or longer period, where a day would be
a file of a few rows); `cells` (user, day, brand) and `life`
(one row per user), a folder for each bucket of users. A new day writes its own folders of the
first two and opens, of the others, the buckets of the users that it or its former version
names. There the cells of the day are exchanged and the lifetime rows of these users are made
anew from their cells; all other rows are carried over. So a day may come again, whole or
corrected, and the tables are those of a rebuild.

What is written waits in the scratch folder until all of it is there. A run that is broken
off while folders are exchanged is completed by running it again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clientele.functions.dates import day_start
from clientele.operators import users as usr
from clientele.session import scratch_dir

BUCKETS = 64
DAY, FOLDER, BUCKET = "session_day", "session_date", "bucket"


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int")


def _cells(lines: DataFrame, buckets: int) -> DataFrame:
    known = lines.where(F.col("user_id").isNotNull() & F.col(DAY).isNotNull())
    return usr.brand_cells(known).withColumn(BUCKET, _bucket(buckets))


def _folder(grain: str) -> Column:
    day = F.to_date(DAY)
    return day if grain == "DAY" else F.trunc(day, grain)


def _marks(marks: DataFrame, grain: str) -> DataFrame:
    """Latest cart and latest purchase of a user on a day, in the form of session marks."""
    at = F.col("session_created_at")
    latest = marks.where(F.col("user_id").isNotNull() & at.isNotNull()).groupBy("user_id", day_start(at).alias(DAY)).agg(
        F.max(F.when(F.col("has_cart"), at)).alias("cart"), F.max(F.when(F.col("has_purchase"), at)).alias("purchase"))
    return latest.withColumn(FOLDER, _folder(grain))


def _put(df: DataFrame, path: str, by: str) -> None:
    """Replace the folders that have rows. A folder is written by one task; a fixed number
    of tasks, because what takes time is the number of folders, not their bytes."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(tasks, by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def _staged(df: DataFrame, name: str) -> DataFrame:
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def create(lines: DataFrame, marks: DataFrame, path: str, buckets: int = BUCKETS, grain: str = "DAY") -> None:
    """Write the tables below a new `path`. `lines` and `marks` as in `users` and `sessions`;
    rows without user or day belong nowhere and are left out. `buckets`: about as many as
    give a bucket the size of a file. `grain`: DAY, MONTH or YEAR. Both stay with the tables."""
    cells = _staged(_cells(lines, buckets), "history-cells")
    _put(cells, f"{path}/cells", BUCKET)
    _put(usr.cell_life(cells).withColumn(BUCKET, _bucket(buckets)), f"{path}/life", BUCKET)
    _put(usr.cell_days(cells).withColumn(FOLDER, _folder(grain)), f"{path}/days", FOLDER)
    _put(_marks(marks, grain), f"{path}/marks", FOLDER)


def add_days(lines: DataFrame, marks: DataFrame, path: str, buckets: int = BUCKETS, grain: str = "DAY") -> list[int]:
    """Take in whole days: all lines and marks of each day that is named. Days that are
    stored are replaced. Gives back the buckets that were opened."""
    spark = lines.sparkSession
    new, seen = _staged(_cells(lines, buckets), "history-cells"), _staged(_marks(marks, grain), "history-marks")
    # dates and bucket numbers: a calendar and BUCKETS rows at most
    dated = new.select(DAY).union(seen.select(DAY)).distinct().select(F.to_date(DAY).alias("day"), _folder(grain).alias(FOLDER)).collect()
    dates, folders = [r["day"] for r in dated], sorted({r[FOLDER] for r in dated})
    stored = {name: spark.read.parquet(f"{path}/{name}").where(F.col(FOLDER).isin(folders)) for name in ("days", "marks")}
    before = stored["days"].where(F.to_date(DAY).isin(dates)).select("user_id")
    touched = _staged(before.union(new.select("user_id")).distinct().withColumn(BUCKET, _bucket(buckets)), "history-users")
    opened = sorted(r[0] for r in touched.select(BUCKET).distinct().collect())
    kept = spark.read.parquet(f"{path}/cells").where(F.col(BUCKET).isin(opened) & ~F.to_date(DAY).isin(dates))
    # a row without user keeps a bucket from being passed over when its last user goes
    empty = spark.createDataFrame([(b,) for b in opened], "bucket int")
    cells = _staged(kept.unionByName(new).where(F.col("user_id").isNotNull()).unionByName(empty, allowMissingColumns=True), "history-cells")
    theirs = cells.join(touched.select("user_id"), "user_id", "left_semi")
    others = spark.read.parquet(f"{path}/life").where(F.col(BUCKET).isin(opened) & F.col("user_id").isNotNull()).join(
        touched.select("user_id"), "user_id", "left_anti")
    life = usr.cell_life(theirs).withColumn(BUCKET, _bucket(buckets))
    life = _staged(others.unionByName(life).unionByName(empty, allowMissingColumns=True), "history-life")
    blank = spark.createDataFrame([(d,) for d in folders], f"{FOLDER} date")
    renewed = {}
    for name, rows in (("days", usr.cell_days(new).withColumn(FOLDER, _folder(grain))), ("marks", seen)):
        others = stored[name].where(~F.to_date(DAY).isin(dates))
        renewed[name] = _staged(rows.unionByName(others).unionByName(blank, allowMissingColumns=True), f"history-{name}")
    _put(cells, f"{path}/cells", BUCKET)
    _put(life, f"{path}/life", BUCKET)
    for name, rows in renewed.items():
        _put(rows, f"{path}/{name}", FOLDER)
    return opened


def read_aggregates(spark: SparkSession, users: DataFrame, path: str) -> DataFrame:
    """user_aggregates from the stored tables; one row with nulls for users without a day."""
    life, days, marks = (spark.read.parquet(f"{path}/{name}").where(F.col("user_id").isNotNull()) for name in ("life", "days", "marks"))
    seen = marks.select("user_id", F.explode(F.array(
        F.struct(F.col("cart").alias("at"), F.lit(True).alias("cart")), F.struct(F.col("purchase").alias("at"), F.lit(False).alias("cart")))).alias("m")
        ).where(F.col("m.at").isNotNull())
    flags = seen.select("user_id", F.col("m.at").alias("session_created_at"), F.col("m.cart").alias("has_cart"),
                        (~F.col("m.cart")).alias("has_purchase"))
    whole = usr.user_global(users, None, flags, life=life.drop(BUCKET))
    return usr.user_aggregates(whole, days.drop(FOLDER).withColumnRenamed("user_id", "id"), "left")
