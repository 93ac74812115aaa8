"""Approximate nearest neighbours with a permutation index.

Every vector is represented by the order of the pivots nearest to it and posted, with
its place in that order, in the inverted files of these pivots. A query looks into the
files of its own nearest pivots only, ranks what it finds by the footrule distance of
the two orders, and computes true distances for the best ranked share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from clientele.llm.vectors import matrix, usable, widest

PIVOTS = 256                 # pivots of the index
SAMPLE = 8192                # rows the pivots are chosen from, by a hash of vec_id
POSTED = 64                  # nearest pivots that post a vector and that a query visits
SHARE, LEAST = 0.15, 512     # of a block, what is compared exactly; at least so many
BLOCK = 16_384               # vectors indexed together in a task
QUERIES = 4096               # queries sent to the blocks at once
RESULT = "query_id long, vec_id long, score double"


def _orders(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The POSTED nearest pivots of each vector, nearest first."""
    far = (pivots ** 2).sum(1)[None] - 2 * vectors @ pivots.T
    return np.argsort(far, axis=1, kind="stable")[:, :POSTED].astype(np.int16)


class Block:
    """Inverted files of a block: for each pivot the vectors it posts and the places."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, orders: np.ndarray, pivots: int):
        self.ids, self.vectors = ids, vectors
        flat = orders.ravel()
        at = np.argsort(flat, kind="stable")
        self.rows, self.places = (at // orders.shape[1]).astype(np.int32), (at % orders.shape[1]).astype(np.int32)
        self.files = np.searchsorted(flat[at], np.arange(pivots + 1))

    def candidates(self, order: np.ndarray) -> np.ndarray:
        """The best by footrule. A pivot in one order only counts as if it came right
        after the end of the other."""
        width = len(order)
        gain = np.zeros(len(self.ids), np.int32)
        for place, pivot in enumerate(order.tolist()):
            a, b = self.files[pivot], self.files[pivot + 1]
            theirs = self.places[a:b]
            gain[self.rows[a:b]] += 2 * width - place - theirs - np.abs(place - theirs)
        n = max(LEAST, int(len(gain) * SHARE))
        return np.argpartition(-gain, n)[:n] if n < len(gain) else np.arange(len(gain))

    def nearest(self, query_id: int, query: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        found = self.candidates(order)
        found = found[self.ids[found] != query_id]
        far = np.sqrt(((self.vectors[found] - query) ** 2).sum(axis=1))
        best = np.lexsort((self.ids[found], far))[:k]
        return self.ids[found][best], far[best]


def build_index(vectors: DataFrame, folder: str) -> np.ndarray:
    """Write the index of vectors(vec_id, embedding) and return the pivots.

    Every usable row is indexed (see vectors.usable; the length most vectors have).
    Rows without vec_id are left out. Pivots are distinct vectors among SAMPLE rows."""
    width = widest(vectors)
    good = vectors.where(usable() & (F.size("embedding") == width) & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    sample = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    _, at = np.unique(matrix(sample["embedding"]), axis=0, return_index=True)
    pivots = matrix(sample["embedding"])[np.sort(at)[:PIVOTS]]

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            points = matrix(batch["embedding"])
            orders = _orders(points, pivots) if len(points) else []
            yield batch.assign(nearest=[o.tobytes() for o in orders])

    good.mapInPandas(post, "vec_id long, embedding array<double>, nearest binary").write.parquet(folder)
    return pivots


def search(index: DataFrame, pivots: np.ndarray, queries: DataFrame, folder: str, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k nearest rows of the index
    found, by Euclidean distance, ties to the smaller vec_id; all, if there are fewer.

    queries(vec_id, embedding): one per vec_id; unusable ones give no row. Rows with the
    vec_id of the query are not candidates. Queries go to the blocks QUERIES at a time;
    a block returns k rows per query, so links are never listed."""
    spark = index.sparkSession
    asked = queries.where(usable() & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked = asked.where(F.size("embedding") == (pivots.shape[1] if len(pivots) else 0)).groupBy("vec_id").agg(
        F.min("embedding").alias("embedding"))
    last = None
    while True:
        part = asked if last is None else asked.where(F.col("vec_id") > last)
        chunk = part.orderBy("vec_id").limit(QUERIES).toPandas()
        if not len(chunk) and last is not None:
            break
        ids, points = chunk["vec_id"].to_numpy(np.int64), matrix(chunk["embedding"])
        sent = spark.sparkContext.broadcast((ids, points, _orders(points, pivots) if len(ids) else None))

        def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, points, orders = sent.value
            for block in _blocks(batches, len(pivots)):
                for query_id, point, order in zip(ids.tolist(), points, orders if orders is not None else [], strict=True):
                    near, far = block.nearest(query_id, point, order, k)
                    yield pd.DataFrame({"query_id": query_id, "vec_id": near, "score": far})

        index.select("vec_id", "embedding", "nearest").mapInPandas(look, RESULT).write.mode("append").parquet(folder)
        sent.unpersist()
        if len(ids) < QUERIES:
            break
        last = int(ids[-1])
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return spark.read.schema(RESULT).parquet(folder).withColumn("rank", F.row_number().over(best)).where(
        F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _blocks(batches: Iterator[pd.DataFrame], pivots: int) -> Iterator[Block]:
    held, size = [], 0

    def block() -> Block:
        frame = pd.concat(held)
        orders = np.stack([np.frombuffer(o, np.int16) for o in frame["nearest"]])
        return Block(frame["vec_id"].to_numpy(np.int64), matrix(frame["embedding"]), orders, pivots)
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= BLOCK:
            yield block()
            held, size = [], 0
    if size:
        yield block()
