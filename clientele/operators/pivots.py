"""Exact similarity search that leaves out block pairs by the triangle inequality.

Corpus rows are dealt into blocks by their nearest pivot; a block knows how near and how far
its rows are from every pivot. For a query these ranges bound the distance to any row of a
block from below. Each query first meets the block that may be nearest. The distance of its
k-th best row there, and the threshold, then drop every block whose bound lies beyond, and
only then do vectors move to the blocks that are left. Queries and corpus stay tables; the
driver sees pivots and ranges, at most MAX_BLOCKS rows of numbers.

Unlike vectors in many dimensions are all about equally far from each other; then no block
can be left out, and the work is that of all pairs in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from clientele.functions.vectors import Best, keys, matrix, narrow, unit
from clientele.session import scratch_dir

PIVOTS = 32
MAX_BLOCKS = 16_384
AT_ONCE = 1 << 16            # pairs of a query and a block that are judged together
REGION_ROWS = 8192           # vectors move to regions of neighbouring blocks, of so many rows, in bundles of so many queries:
MOST_ROWS, REGION_BLOCKS = 65_536, 64    # of more, up to so many rows and blocks, if there are still TASKS bundles and regions to meet
TASKS = 32
SLACK = 1e-6                 # similarities are rounded; bounds must not cut at the last digits


def _placed(df: DataFrame, key: str, pivots: np.ndarray, cosine: bool) -> DataFrame:
    """Adds the distances to all pivots; vectors that can match nothing go."""
    def place(batches):
        for batch in batches:
            vectors = matrix(batch["embedding"])
            if not len(vectors):
                continue
            vectors = unit(vectors) if cosine else vectors
            usable = np.flatnonzero(np.isfinite(vectors).all(axis=1))
            vectors = vectors[usable]
            far = np.stack([np.linalg.norm(vectors - p, axis=1) for p in pivots], axis=1) if len(pivots) else np.zeros((len(usable), 1))
            ends = pa.array(np.arange(len(usable) + 1) * far.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*batch.select([key, "embedding"]).take(pa.array(usable)).columns, pa.ListArray.from_arrays(ends, pa.array(far.ravel())),
                 pa.array(far.argmin(axis=1).astype(np.int32))], [key, "embedding", "far", "home"])

    schema = T.StructType([df.schema[key], df.schema["embedding"], T.StructField("far", T.ArrayType(T.DoubleType())),
                           T.StructField("home", T.IntegerType())])
    return df.select(key, "embedding").mapInArrow(place, schema)


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _dealt(corpus: DataFrame, block_rows: int, asked: int) -> tuple[DataFrame, int, int]:
    """Adds `block`: by the nearest pivot, large ones in several parts, and `region`: so many
    neighbouring blocks, the second result. Ranges leave out blocks, rows move by region. The
    third result is the size of a bundle of so many queries asked."""
    sizes = {r["home"]: r["n"] for r in corpus.groupBy("home").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = max(block_rows, -(-sum(sizes.values()) // (MAX_BLOCKS - PIVOTS)))
    parts = [-(-sizes.get(h, 0) // rows) for h in range(PIVOTS)]
    first = np.concatenate([[0], np.cumsum(parts)]).tolist()
    part = F.pmod(F.xxhash64("id"), F.get(F.array(*[F.lit(max(1, p)) for p in parts]), F.col("home")))
    side = max(REGION_ROWS, min(MOST_ROWS, math.isqrt(asked * sum(sizes.values()) // TASKS)))
    joined = max(1, REGION_ROWS // rows, min(REGION_BLOCKS, side * sum(parts) // max(1, sum(sizes.values()))))
    corpus = corpus.withColumn("block", (F.get(F.array(*[F.lit(f) for f in first]), F.col("home")) + part).cast("int"))
    return corpus.withColumn("region", F.floor(F.col("block") / joined).cast("int")), joined, side


class Ranges:
    """Of every block the number of rows and the nearest and farthest of them from each pivot."""

    def __init__(self, corpus: DataFrame, pivots: int):
        at = range(max(1, pivots))
        table = corpus.groupBy("block").agg(
            F.count(F.lit(1)).alias("n"), F.array(*[F.min(F.get("far", F.lit(i))) for i in at]).alias("low"),
            F.array(*[F.max(F.get("far", F.lit(i))) for i in at]).alias("high")).toArrow()
        self.blocks = table["block"].to_numpy()
        self.rows, self.low, self.high = table["n"].to_numpy(), matrix(table["low"]), matrix(table["high"])

    def nearest(self, far: np.ndarray) -> np.ndarray:
        """Queries x blocks: no row of the block is nearer."""
        out = np.zeros((len(far), len(self.blocks)))
        for p in range(far.shape[1]):
            mine = far[:, p, None]
            np.maximum(out, self.low[None, :, p] - mine, out=out)
            np.maximum(out, mine - self.high[None, :, p], out=out)
        return out


def _meet(queries: DataFrame, corpus: DataFrame, schema: T.StructType, out: pa.Schema, options: dict, bundle_rows: int) -> DataFrame:
    """Queries(qid, embedding, region, blocks, least) against the rows of their blocks; a region
    that many queries go to is met in several tasks. Rows below `least` are left out."""
    counts = queries.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / bundle_rows).cast("int").alias("_parts")).toArrow()
    visits = F.broadcast(queries.sparkSession.createDataFrame(counts))          # MAX_BLOCKS rows at most
    asked = queries.join(visits, "region").withColumn("part", F.pmod(F.xxhash64("qid"), F.col("_parts")).cast("int"))
    stored = corpus.join(visits, "region").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))

    def search(some: pa.Table, rows: pa.Table) -> pa.Table:
        floor = some["least"].to_numpy().astype(np.float64)
        best = Best(keys(some["qid"]), matrix(some["embedding"]), floor=floor, **options)
        read = narrow if options["metric"] == "cosine" else matrix
        ids, vectors, of_row = keys(rows["id"]), read(rows["embedding"]), rows["block"].to_numpy()
        wanted = some["blocks"].combine_chunks()
        who = np.repeat(np.arange(len(wanted)), np.diff(wanted.offsets.to_numpy()))
        named = wanted.flatten().to_numpy()
        blocks, visitors = np.unique(named, return_counts=True)
        all_go = np.isin(of_row, blocks[visitors == len(wanted)])
        best.add(ids[all_go], vectors[all_go])
        few = visitors < len(wanted)
        order = np.argsort(named, kind="stable")
        ends = np.cumsum(visitors)
        by_block = np.argsort(of_row, kind="stable")
        low, high = (np.searchsorted(of_row[by_block], blocks, at) for at in ("left", "right"))
        for i in np.flatnonzero(few).tolist():
            at = by_block[low[i]:high[i]]
            best.add(ids[at], vectors[at], only=who[order[ends[i] - visitors[i]:ends[i]]])
        return best.table(out)

    key = ["region", "part"]
    asked, stored = asked.select(*key, "qid", "embedding", "blocks", "least"), stored.select(*key, "id", "embedding", "block")
    return asked.groupBy(*key).cogroup(stored.groupBy(*key)).applyInArrow(search, schema)


def _visits(queries: DataFrame, ranges, joined: int, choose: Callable, more: str) -> DataFrame:
    """A row for every region a query goes to, with its blocks there; `choose` gives queries x
    blocks, true or false. `more` is a column that goes with it."""
    def go(batches):
        order = np.argsort(ranges.value.blocks)
        blocks = ranges.value.blocks[order].astype(np.int32)
        regions, starts = np.unique(blocks // joined, return_index=True)
        step = max(1, AT_ONCE // len(blocks))
        for batch in (b.slice(i, step) for b in batches for i in range(0, len(b), step)):
            chosen = choose(ranges.value, batch)[:, order]
            counts = np.add.reduceat(chosen.astype(np.int32), starts, axis=1)
            who, where = np.nonzero(counts)
            ends = np.concatenate([[0], np.cumsum(counts[who, where])])
            kept = batch.select(names).take(pa.array(who))
            there = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(blocks[np.nonzero(chosen)[1]]))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(regions[where].astype(np.int32)), there], [*names, "region", "blocks"])

    names = ["qid", "embedding", more]
    schema = T.StructType([*(queries.schema[n] for n in names), T.StructField("region", T.IntegerType()),
                           T.StructField("blocks", T.ArrayType(T.IntegerType()))])
    return queries.mapInArrow(go, schema)


def _first(ranges: Ranges, batch: pa.RecordBatch) -> np.ndarray:
    """The block that may be nearest, and of several such the one that is nearest at worst."""
    far = matrix(batch["far"])
    least = ranges.nearest(far)
    most = np.min(far[:, None, :] + ranges.high[None], axis=2)
    at = np.lexsort((most, least), axis=-1)[:, 0]
    return np.arange(len(ranges.blocks))[None, :] == at[:, None]


def _rest(ranges: Ranges, batch: pa.RecordBatch) -> np.ndarray:
    """All other blocks that may hold a row as near as the bound."""
    other = ranges.blocks[None, :] != batch["blocks"].flatten().to_numpy()[:, None]       # each has one
    return other & (ranges.nearest(matrix(batch["far"])) <= batch["bound"].to_numpy()[:, None] + SLACK)


def search(asked: DataFrame, stored: DataFrame, schema: T.StructType, out: pa.Schema, options: dict, block_rows: int,
           met: list | None = None) -> DataFrame:
    """(qid, id, similarity) of asked(qid, embedding) and stored(id, embedding), not yet
    ranked. `met`, if given, gets the frames of (qid, block) visits and the ranges, from
    which the share of pairs that were compared follows."""
    spark, folder = asked.sparkSession, scratch_dir(asked.sparkSession, "pivots")
    cosine, k, threshold = options["metric"] == "cosine", options["k"], options["threshold"]
    sample = matrix(stored.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).select("embedding").toArrow()["embedding"])
    pivots = unit(sample) if cosine and len(sample) else sample
    pivots = pivots[np.isfinite(pivots).all(axis=1)] if len(pivots) else np.empty((0, 0))
    queries = _written(_placed(asked, "qid", pivots, cosine), f"{folder}/queries")
    corpus, joined, side = _dealt(_written(_placed(stored, "id", pivots, cosine), f"{folder}/corpus"), block_rows, queries.count())
    found_ranges = Ranges(corpus, len(pivots))
    if not len(found_ranges.blocks):
        return spark.createDataFrame([], schema)
    ranges = spark.sparkContext.broadcast(found_ranges)
    rows = corpus.select("id", "embedding", "block", "region")
    home = _written(_visits(queries, ranges, joined, _first, "far"), f"{folder}/home")
    nothing = F.lit(None).cast("double").alias("least")
    first = _written(_meet(home.select("qid", "embedding", "region", "blocks", nothing), rows, schema, out, options, side), f"{folder}/first")

    def distance(similarity):
        return F.sqrt(F.greatest(2 - 2 * similarity, F.lit(0.0))) if cosine else -similarity

    # the k-th best so far bounds the blocks, and the rows there
    full = F.count(F.lit(1)) >= k
    limits = first.groupBy("qid").agg(F.when(full, F.min("similarity")).alias("least"), F.when(full, distance(F.min("similarity"))).alias("bound"))
    beyond = F.lit(np.inf) if threshold is None else distance(F.lit(float(threshold)))
    left = home.join(limits, "qid", "left").withColumn("bound", F.least(F.coalesce("bound", F.lit(np.inf)), beyond))
    rest = _visits(left, ranges, joined, _rest, "least")
    if met is not None:
        met += [*(v.select("qid", F.explode("blocks").alias("block")) for v in (home, rest)), found_ranges]
    return first.unionByName(_meet(rest, rows, schema, out, options, side))
