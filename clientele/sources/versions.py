"""Tables whose versions are named by manifests.

Data folders are written once and never changed. A manifest lists the folders that make up a
version. It is written last and by a rename that does not replace, so a reader sees the version
before a change or the one after it, a run that was broken off leaves the version before, and of
two writers that start from one version the second fails and may try again.

Two kinds of table: periods (`replace_days`), and runs of partial results (`add_run`), which are
merged like a log-structured store: as many runs of one level as `fan_in` become a run of the next.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

FAN_IN = 8              # runs of a level that are merged; a read meets fewer than this a level
KEEP_VERSIONS = 4       # versions that can still be read
RUN = "_run"            # the folder of one write, a partition column for Spark's reader
NULL_PERIOD = "__HIVE_DEFAULT_PARTITION__"


class Folder(NamedTuple):
    """`period`: the value of the partition column, or none. `level`: how often its rows were merged."""
    name: str
    period: str | None = None
    level: int = 0


class Version(NamedTuple):
    """`mark`: the number of the last change that is in it; -1 before the first one."""
    number: int
    folders: tuple[Folder, ...]
    mark: int


def _paths(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    return hadoop, hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _manifest(path: str, number: int) -> str:
    return f"{path}/manifest/{number:012d}.json"


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that can be read, oldest first."""
    hadoop, fs = _paths(spark, path)
    folder = hadoop.Path(f"{path}/manifest")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def load(spark: SparkSession, path: str, number: int) -> Version:
    schema = "mark long, folders array<struct<name string, period string, level int>>"
    row = spark.read.schema(schema).json(_manifest(path, number)).first()
    return Version(number, tuple(Folder(*f) for f in row.folders), row.mark)


def current(spark: SparkSession, path: str) -> Version:
    """The newest version; one without folders where there is no table yet."""
    known = versions(spark, path)
    return load(spark, path, known[-1]) if known else Version(-1, (), -1)


def commit(spark: SparkSession, path: str, base: Version, folders: Iterable[Folder], mark: int | None = None) -> Version:
    """Make `folders` the version after `base`. Fails where that version exists already."""
    new = Version(base.number + 1, tuple(folders), base.mark if mark is None else mark)
    hadoop, fs = _paths(spark, path)
    waiting = hadoop.Path(f"{path}/manifest/.{uuid.uuid4().hex}")
    out = fs.create(waiting, False)
    out.write(bytearray(json.dumps({"mark": new.mark, "folders": [f._asdict() for f in new.folders]}), "utf-8"))
    out.close()
    context = hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    how = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        context.rename(waiting, hadoop.Path(_manifest(path, new.number)), how)
    except Exception:
        fs.delete(waiting, False)
        raise
    return new


def read(spark: SparkSession, path: str, schema: T.StructType, version: Version | None = None) -> DataFrame:
    """The rows of a version, by default of the newest one."""
    return _rows(spark, path, schema, (version or current(spark, path)).folders)


def _rows(spark: SparkSession, path: str, schema: T.StructType, folders: Iterable[Folder]) -> DataFrame:
    paths = [f"{path}/{f.name}" for f in folders]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*paths).select(*schema.names)


def _new_run() -> str:
    return f"data/{RUN}={uuid.uuid4().hex}"


def replace_days(df: DataFrame, path: str, by: str, day: str = "session_day") -> Version:
    """Replace the days present in `df`; creates the table. `by`: the date column that names the
    period (the day itself, or its month or year). Other days of a period are carried over into
    its new folder. Running it twice gives the same rows; rows without a day are one day."""
    if df.schema[by].dataType != T.DateType():
        raise ValueError(f"{by} must be a date")
    spark, base, run = df.sparkSession, current(df.sparkSession, path), _new_run()
    touched = {NULL_PERIOD if r[0] is None else str(r[0]) for r in df.select(by).distinct().collect()}    # a calendar
    if not touched and base.number >= 0:
        return base
    days = df.select(F.to_date(day).alias("_day")).distinct()
    stored = _rows(spark, path, df.schema, [f for f in base.folders if f.period in touched])
    kept = stored.join(days, F.to_date(stored[day]).eqNullSafe(days["_day"]), "left_anti")
    df.unionByName(kept).hint("rebalance", by).write.partitionBy(by).parquet(f"{path}/{run}")
    new = [Folder(f"{run}/{by}={p}", p) for p in sorted(touched)]
    return commit(spark, path, base, [f for f in base.folders if f.period not in touched] + new)


def add_run(df: DataFrame, path: str, mark: int, merge: Callable[[DataFrame], DataFrame] | None = None,
            fan_in: int = FAN_IN, keep: int = KEEP_VERSIONS) -> Version:
    """Add partial results as change number `mark`; a change that is in the table already is left out.

    `merge` must give rows of the same columns that stand for the same result. A level with `fan_in` runs
    is merged into one run of the next level before the change shows, so the history is read
    again only as often as there are levels. Old versions and their folders go, but for `keep`."""
    if fan_in < 2:
        raise ValueError("fan_in must be 2 or more")
    spark, base = df.sparkSession, current(df.sparkSession, path)
    if mark <= base.mark:
        return base
    name, passing = _new_run(), []
    df.write.parquet(f"{path}/{name}")
    folders, level = [*base.folders, Folder(name)], 0
    while merge and sum(f.level == level for f in folders) >= fan_in:
        taken = [f for f in folders if f.level == level]
        name = _new_run()
        _as(merge(_rows(spark, path, df.schema, taken)), df.schema).write.parquet(f"{path}/{name}")
        folders = [f for f in folders if f.level != level] + [Folder(name, None, level + 1)]
        passing += [f for f in taken if f not in base.folders]
        level += 1
    new = commit(spark, path, base, folders, mark)
    _delete(spark, path, passing)           # no version has named them
    forget(spark, path, keep)
    return new


def _as(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of `schema`: sums of sums are wider. A type that differs in nullability only is left."""
    return df.select(*[F.col(c.name) if df.schema[c.name].dataType.simpleString() == c.dataType.simpleString()
                       else F.col(c.name).cast(c.dataType) for c in schema])


def forget(spark: SparkSession, path: str, keep: int = KEEP_VERSIONS) -> None:
    """Delete all versions but the newest `keep`, and the folders that only they name. What a
    run that was broken off has left is named by no version and is not touched."""
    known = versions(spark, path)
    old, kept = known[:-keep] if keep else [], known[-keep:]
    if not old:
        return
    used = {f for n in kept for f in load(spark, path, n).folders}
    unused = {f for n in old for f in load(spark, path, n).folders} - used
    hadoop, fs = _paths(spark, path)
    _delete(spark, path, unused)
    for n in old:
        fs.delete(hadoop.Path(_manifest(path, n)), False)


def _delete(spark: SparkSession, path: str, folders: Iterable[Folder]) -> None:
    hadoop, fs = _paths(spark, path)
    for f in folders:
        fs.delete(hadoop.Path(f"{path}/{f.name}"), True)
