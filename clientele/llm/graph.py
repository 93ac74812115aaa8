"""Connected components of a link table, by alternating stars.

A large star points the larger neighbours of every node at the smallest id around it, a
small star does so for the smaller ones. When both leave the table as it is, each node
points at the smallest id of its component. Every round is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clientele.session import scratch_dir


def _star(edges: DataFrame) -> DataFrame:
    """Edges (a, b): every b is pointed at the smallest b of its a. Both sides come by a, so
    the join is a merge where they meet; a broadcast would be one more round of tasks and
    pass the driver."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    return edges.join(least.hint("merge"), "a")


def _round(edges: DataFrame) -> DataFrame:
    """Three rounds of tasks: large star, small star, the different edges."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    large = _star(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "least").alias("b")).repartition("a").distinct()
    # once to each end, so that the small star is not made twice
    ends = F.explode(F.array(F.struct(F.col("b").alias("a"), "least"), F.struct("a", "least"))).alias("end")
    return _star(large).select(ends).select(F.col("end.a").alias("a"), F.col("end.least").alias("b")).where("a <> b").distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) of every id in links(a, b): the smallest id it reaches. Repeated
    links, both directions and links of an id with itself are fine; null ends are left
    out. Without links there is no row."""
    spark = links.sparkSession
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(
        F.col("a").isNotNull() & F.col("b").isNotNull())
    loops = edges.where("a = b").select("a").distinct()
    known, edges = None, edges.where("a <> b").distinct()
    while True:
        path = scratch_dir(spark, name)
        edges.write.parquet(path)
        edges = spark.read.parquet(path)
        state = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if state == known or state[0] == 0:
            break
        known, edges = state, _round(edges)
    found = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component"))
    return found.unionByName(roots).unionByName(loops.select(F.col("a").alias("id"), F.col("a").alias("component"))) \
        .groupBy("id").agg(F.min("component").alias("component"))
