"""Similarity search: the k most similar corpus rows for every query vector.

Exact, in two ways. Both score blocks of vectors in numpy and keep k rows per
query and block; pairs are never listed.

* strategy "scan": up to QUERY_ROWS queries are shipped to all tasks and the corpus is
  scanned once where it lies - no shuffle. More queries go through "blocks";
* strategy "blocks": any number of queries, which stay a table. Distances to pivots tell
  which blocks of the corpus a query has to meet, see `pivots`. With equality filters that
  apply before ranking, both sides are hashed into blocks of about BLOCK_ROWS rows within
  their group, and every query block of a group meets every corpus block of it; so does the
  inner product, which is no distance.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from clientele.functions.vectors import METRICS, Best, keys, matrix
from clientele.operators import pivots
from clientele.operators.buckets import search_corpus

QUERY_ROWS = 10_000
BLOCK_ROWS = 10_000
MOVED_ROWS = 4096


def _result_schema(queries: DataFrame, corpus: DataFrame, qid: str, id_: str) -> T.StructType:
    return T.StructType([T.StructField("qid", queries.schema[qid].dataType),
                         T.StructField("id", corpus.schema[id_].dataType),
                         T.StructField("similarity", T.DoubleType())])


def _arrow(schema: T.StructType) -> pa.Schema:
    return pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])


def _group(columns: list[str] | None) -> Column:
    """Equality columns as one text key; rows with a NULL in it never match."""
    if not columns:
        return F.lit("")
    return F.concat(*[F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"),
                               F.col(c).cast("string")) for c in columns])


def _scan(few: pa.Table, corpus: DataFrame, schema: T.StructType, options: dict, grouped: bool) -> DataFrame:
    """Queries to the corpus: one pass over it, k rows per query and task."""
    shipped = corpus.sparkSession.sparkContext.broadcast(few)
    out = _arrow(schema)

    def search(batches):
        asked = shipped.value
        best = Best(keys(asked["qid"]), matrix(asked["embedding"]), tenants=keys(asked["_g"]) if grouped else None,
                    **options)
        for batch in batches:
            best.add(keys(batch["id"]), matrix(batch["embedding"]), keys(batch["_g"]) if grouped else None)
        yield from best.table(out).to_batches()

    return corpus.mapInArrow(search, schema)


def _blocks(queries: DataFrame, corpus: DataFrame, schema: T.StructType, options: dict, grouped: bool,
            block_rows: int) -> DataFrame:
    """Query blocks against corpus blocks, within a group. Every row moves once for each block
    of the other side, so blocks that move are not smaller than MOVED_ROWS."""
    def blocks(rows: Column) -> Column:
        return F.ceil(rows / F.lit(max(block_rows, MOVED_ROWS))).cast("int")

    if grouped:
        sizes = (queries.groupBy("_g").agg(blocks(F.count(F.lit(1))).alias("_nq"))
                 .join(corpus.groupBy("_g").agg(blocks(F.count(F.lit(1))).alias("_nv")), "_g"))
        q, v = queries.join(sizes, "_g"), corpus.join(sizes, "_g")
    else:
        nq = queries.agg(blocks(F.count(F.lit(1))).alias("n")).scalar()
        nv = corpus.agg(blocks(F.count(F.lit(1))).alias("n")).scalar()
        q = queries.withColumn("_nq", nq).withColumn("_nv", nv).where("_nq > 0 and _nv > 0")
        v = corpus.withColumn("_nq", nq).withColumn("_nv", nv).where("_nq > 0 and _nv > 0")

    def numbers(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    q = q.withColumn("_qb", F.pmod(F.xxhash64("qid"), "_nq").cast("int")).withColumn("_vb", numbers("_nv"))
    v = v.withColumn("_vb", F.pmod(F.xxhash64("id"), "_nv").cast("int")).withColumn("_qb", numbers("_nq"))
    key, out = ["_g", "_qb", "_vb"], _arrow(schema)

    def search(asked: pa.Table, stored: pa.Table) -> pa.Table:
        best = Best(keys(asked["qid"]), matrix(asked["embedding"]), **options)
        best.add(keys(stored["id"]), matrix(stored["embedding"]))
        return best.table(out)

    # the join with the sizes leaves a group in one task; its block pairs are to be spread
    q, v = (side.repartition(*key) for side in (q.select(*key, "qid", "embedding"), v.select(*key, "id", "embedding")))
    return q.groupBy(*key).cogroup(v.groupBy(*key)).applyInArrow(search, schema)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """Best k per query over all tasks; the rank filter prunes before the shuffle."""
    order = Window.partitionBy("qid").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def similar(queries: DataFrame, corpus: DataFrame, k: int, threshold: float | None = None, *, metric: str = "cosine",
            qid: str = "qid", id_: str = "id", vector: str = "embedding", pre_filter: list[str] | None = None,
            post_filter: list[str] | None = None, exclude_same_id: bool = False, strategy: str = "scan",
            query_rows: int = QUERY_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(qid, id, similarity, rank) of the k nearest rows above a threshold.

    pre_filter   columns that must be equal before ranking
    strategy     "scan" or "blocks", see above; the rows are the same
    post_filter  columns that must be equal after ranking: a query may then get
                 fewer than k rows although more would qualify
    Similarity is 1 - cosine distance, the inner product, or minus the L2
    distance; it must be strictly above the threshold. NULL and zero-length
    vectors match nothing."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    schema = _result_schema(queries, corpus, qid, id_)
    asked = queries.where(F.col(vector).isNotNull()).select(
        F.col(qid).alias("qid"), F.col(vector).alias("embedding"), _group(pre_filter).alias("_g"))
    stored = corpus.where(F.col(vector).isNotNull()).select(
        F.col(id_).alias("id"), F.col(vector).alias("embedding"), _group(pre_filter).alias("_g"))
    if pre_filter:
        asked, stored = asked.where(F.col("_g").isNotNull()), stored.where(F.col("_g").isNotNull())
    options = dict(k=k, metric=metric, threshold=threshold, exclude_same_id=exclude_same_id)
    if strategy == "scan":
        few = asked.limit(query_rows + 1).toArrow()
    if strategy == "scan" and len(few) <= query_rows:
        found = _scan(few, stored, schema, options, bool(pre_filter))
    elif pre_filter or metric == "ip":
        found = _blocks(asked, stored, schema, options, bool(pre_filter), block_rows)
    else:
        found = pivots.search(asked, stored, schema, _arrow(schema), options, block_rows)
    top = _ranked(found, k)
    if post_filter:
        mine = queries.select(F.col(qid).alias("qid"), *[F.col(c).alias(f"_q_{c}") for c in post_filter])
        theirs = corpus.select(F.col(id_).alias("id"), *[F.col(c).alias(f"_v_{c}") for c in post_filter])
        top = top.join(mine, "qid").join(theirs, "id")
        for c in post_filter:
            top = top.where(F.col(f"_q_{c}") == F.col(f"_v_{c}"))
    return top.select("qid", "id", "similarity", "rank")


def similar_lsh(queries: DataFrame, corpus: DataFrame, k: int, threshold: float | None = None, *,
                exclude_same_id: bool = False, **options) -> DataFrame:
    """Approximate `similar` by cosine, see `buckets`: only vectors in visited cells are
    compared. `options` are those of `buckets.search_corpus` and `buckets.Tables`."""
    found = search_corpus(queries, corpus, k, threshold, exclude_same_id=exclude_same_id, **options)
    near = found.where(F.col("qid").isNotNull()).select("qid", "id", "similarity").distinct()
    return _ranked(near, k).select("qid", "id", "similarity", "rank")
