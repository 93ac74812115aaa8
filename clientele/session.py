"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Runtime SQL settings every plan in this package counts on. All of them can be
# changed on a running session. `forceOptimizeSkewedJoin` lets the adaptive
# planner split a hot key although that costs one more shuffle downstream; it
# acts only on partitions that were measured as skewed.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A join on (user, session, start) may reuse data already hashed by session.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


# A shuffle may be cut into so many parts, and the adaptive planner gathers small ones up to
# this size, so that the memory of a task does not grow with the tables. Rows of keys and
# prices take up to 30 times as much in a hash table as on the wire.
LEAST_PARTS, PART_BYTES = 400, 8 << 20
# Rows go to Python in batches of up to so many bytes: 10,000 texts, as Spark deals them out by
# default, are tens of MB in each worker and as much again beside the heap.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_PARTS, _SIZE = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def build_session(app: str = "clientele", master: str | None = None, **settings: str) -> SparkSession:
    """A session for tests, benchmarks and scripts. On a cluster `spark-submit`
    names the master and the memory; here only the SQL settings are fixed."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else made, and give its workers
    this package: they do not share the driver's module path."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    ship(spark)
    return spark


def _bytes(size: str) -> int:
    number, unit = re.fullmatch(r"\s*(\d+)\s*([kmgtp]?)i?b?\s*", size.lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def bound_tasks(spark: SparkSession) -> SparkSession:
    """Shuffles in parts of bounded size; a session that asks for more or smaller parts keeps its own."""
    if _bytes(spark.conf.get(_SIZE, "64m")) > PART_BYTES:
        spark.conf.set(_SIZE, str(PART_BYTES))
    if int(spark.conf.get(_PARTS, None) or spark.conf.get("spark.sql.shuffle.partitions")) < LEAST_PARTS:
        spark.conf.set(_PARTS, str(LEAST_PARTS))
    return spark


def bound_batches(spark: SparkSession) -> SparkSession:
    """Batches of bounded size for Python; a session that asks for smaller ones keeps its own."""
    if _bytes(spark.conf.get(_BATCH)) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    return spark


def free_tasks(spark: SparkSession) -> SparkSession:
    """Takes the number of parts back that `bound_tasks` has set; batches are bounded instead."""
    if spark.conf.get(_PARTS, None) == str(LEAST_PARTS):
        spark.conf.unset(_PARTS)
    return bound_batches(spark)


_shipped: set[str] = set()          # applications whose workers have the package


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, once per application. An installed or zipped
    package is left to the installation."""
    context, package = spark.sparkContext, os.path.dirname(os.path.abspath(__file__))
    if context.applicationId in _shipped or not os.path.isdir(package):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="clientele-ship-"), "clientele.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    out.write(file, os.path.join("clientele", os.path.relpath(file, package)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


_local_base: tempfile.TemporaryDirectory | None = None      # of a local session; goes when Python ends


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder in `spark.checkpoint.dir`.

    Intermediate tables, streaming checkpoints and stream outputs go there so
    that they survive the loss of an executor. Without the setting a local
    session falls back to a temporary folder; a cluster session is refused,
    because a machine-local folder cannot be read by the other executors.
    """
    global _local_base
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        _local_base = _local_base or tempfile.TemporaryDirectory(prefix="clientele-")
        base = _local_base.name
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
