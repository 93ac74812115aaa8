"""Approximate similarity search by bucket length.

Each hash table projects a vector on a few directions and cuts the projections into buckets
of a given length; the buckets of all its directions are the cell of the vector. The number
of directions follows from the counted corpus, so cells hold few rows at any size. A query
visits, in each table, its own cell and those around it that a near vector is most probably
in: the nearest bucket borders are crossed first, in the order of a fixed template of sets.

Only vectors of visited cells are compared. The index is a table sorted by cell and cut into
shards of SHARD_ROWS; queries stay a table, cut into bundles of QUERY_ROWS. Every bundle meets
every shard in a task of its own: there the cells that the bundle visits are looked up among
those of the shard, and a cell is compared with all its visitors at once.
"""

from __future__ import annotations

import functools
import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from clientele.functions.vectors import Best, keys, matrix, narrow, unit
from clientele.session import scratch_dir

LENGTH = 2.5                 # of a bucket; projections of unlike vectors differ by 1.4 on average
TABLES = 2
QUERY_ROWS, SHARD_ROWS = 32_768, 131_072     # at most; fewer if there were less than TASKS bundles and shards to meet
LEAST_ROWS, TASKS = 4096, 32
SLICE, VISITS = 64, 1 << 22          # queries that are looked up at once, and visits that are sorted at once
FIRST = 16                           # this part of the visits, the most promising ones, comes first
CROSSED = 5                  # borders crossed at once, at most


def hashes_for(rows: int, dimensions: int) -> int:
    """Directions of a table for a corpus of so many rows."""
    return min(dimensions, max(4, int(math.log(max(1, rows)))))


def probes_for(hashes: int) -> int:
    """Cells visited in a table. They grow more slowly than all cells do, so the share of
    the corpus that is compared falls as it grows."""
    return int(7 * 1.6 ** hashes)


@functools.lru_cache(maxsize=8)
def crossings(hashes: int, probes: int) -> list[tuple[int, ...]]:
    """Sets of borders to cross, the most promising first. A query's 2 x hashes borders are
    numbered from 1 by their distance from it; border j and the opposite one, which comes
    last as j comes first, never go together. The order is that of the expected squared
    distances, in whole numbers."""
    last, whole = 2 * hashes, 4 * (hashes + 1) * (hashes + 2)

    def cost(j: int) -> int:
        far = last + 1 - j
        return j * (j + 1) if j <= hashes else whole - 4 * (hashes + 2) * far + far * (far + 1)

    sets = [s for n in range(min(CROSSED, hashes) + 1) for s in itertools.combinations(range(1, last + 1), n)
            if len({min(j, last + 1 - j) for j in s}) == n]
    return sorted(sets, key=lambda s: (sum(map(cost, s)), len(s), s))[:probes]


@functools.lru_cache(maxsize=8)
def _grown(hashes: int, probes: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For sets of 1, 2, ... borders: their places in `crossings`, those of the sets without
    the last border, which cost less and so come before them, and the last borders."""
    sets = crossings(hashes, probes)
    at = {s: i for i, s in enumerate(sets)}
    out = []
    for n in range(1, max(map(len, sets), default=0) + 1):
        mine = [s for s in sets if len(s) == n]
        out.append((np.array([at[s] for s in mine]), np.array([at[s[:-1]] for s in mine]), np.array([s[-1] - 1 for s in mine])))
    return out


@dataclass(frozen=True)
class Tables:
    """Directions, offsets and the template; the same for the same sizes and seed."""
    dimensions: int
    hashes: int
    probes: int
    tables: int = TABLES
    length: float = LENGTH
    seed: int = 0

    @functools.lru_cache(maxsize=8)
    def directions(self) -> np.ndarray:
        """tables x dimensions x hashes. Orthogonal within a table; fewer hashes take the first ones."""
        rng = np.random.default_rng(self.seed)
        made = [np.linalg.qr(rng.standard_normal((self.dimensions, self.dimensions)))[0] for _ in range(self.tables)]
        return np.stack(made)[:, :, :self.hashes] * math.sqrt(self.dimensions)

    def offsets(self) -> np.ndarray:
        return np.random.default_rng(self.seed + 1).random((self.tables, self.dimensions))[:, :self.hashes]

    def _names(self) -> np.ndarray:
        """A cell is named by a sum of its bucket numbers times these, modulo 2^64. Two
        cells of one name are searched together, which costs time and loses nothing."""
        return np.random.default_rng(self.seed + 2).integers(-2 ** 62, 2 ** 62, (self.tables, self.dimensions))[:, :self.hashes]

    def places(self, vectors: np.ndarray, table: int) -> np.ndarray:
        """Projections in units of the bucket length."""
        return unit(vectors) @ self.directions()[table] / self.length + self.offsets()[table]

    def cells(self, vectors: np.ndarray, table: int) -> np.ndarray:
        return (np.floor(self.places(vectors, table)).astype(np.int64) * self._names()[table]).sum(axis=1)

    def visited(self, vectors: np.ndarray, table: int) -> np.ndarray:
        """vectors x probes: the cells a query goes to."""
        at = self.places(vectors, table)
        low = np.floor(at)
        into = at - low
        borders = np.argsort(np.concatenate([into, 1 - into], axis=1), axis=1, kind="stable")
        names = self._names()[table]
        steps = np.concatenate([-names, names])[borders].T
        cells = np.empty((len(crossings(self.hashes, self.probes)), len(vectors)), np.int64)
        cells[:1] = (low.astype(np.int64) * names).sum(axis=1)
        for mine, shorter, last in _grown(self.hashes, self.probes):
            cells[mine] = cells[shorter] + steps[last]
        return cells.T


def tables_for(corpus: DataFrame, vector: str = "embedding", probes: int | None = None, **options) -> Tables:
    """Hash tables for a corpus, from its count and the size of its vectors."""
    size = corpus.agg(F.count(vector).alias("rows"), F.max(F.size(vector)).alias("dimensions")).first()
    dimensions = max(1, size["dimensions"] or 1)
    hashes = hashes_for(size["rows"], dimensions)
    return Tables(dimensions, hashes, probes or probes_for(hashes), **options)


def write_index(corpus: DataFrame, tables: Tables, folder: str, id_: str = "id", vector: str = "embedding",
                shards: int = 1) -> DataFrame:
    """The index (hash_table, cell, id, embedding, shard), a row for each vector and table, in
    the order of the cells; a large cell may go on in the next shard. Null and zero vectors are
    left out."""
    kind = corpus.schema[id_].dataType

    def put(batches):
        for batch in batches:
            vectors = matrix(batch["embedding"])
            usable = np.flatnonzero(np.linalg.norm(vectors, axis=1) > 0) if len(vectors) else np.empty(0, np.int64)
            if not len(usable):
                continue
            kept = batch.take(pa.array(usable))
            for t in range(tables.tables):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(usable), t, np.int32)), pa.array(tables.cells(vectors[usable], t)), *kept.columns],
                    ["hash_table", "cell", "id", "embedding"])

    numbers = _numbers(corpus, vector)
    schema = T.StructType([T.StructField("hash_table", T.IntegerType()), T.StructField("cell", T.LongType()),
                           T.StructField("id", kind), T.StructField("embedding", numbers)])
    rows = corpus.where(F.col(vector).isNotNull()).select(F.col(id_).alias("id"), F.col(vector).cast(numbers).alias("embedding"))
    order = ["hash_table", "cell", "id"]
    (rows.mapInArrow(put, schema).repartitionByRange(shards, *order).sortWithinPartitions(*order)
     .withColumn("shard", F.spark_partition_id()).write.parquet(folder))
    return corpus.sparkSession.read.schema(T.StructType([*schema.fields, T.StructField("shard", T.IntegerType())])).parquet(folder)


def _numbers(df: DataFrame, vector: str) -> T.ArrayType:
    """Vectors of floats move as floats, others as doubles."""
    kind = df.schema[vector].dataType
    return T.ArrayType(T.FloatType() if isinstance(kind, T.ArrayType) and kind.elementType == T.FloatType() else T.DoubleType())


class Shard:
    """Rows of one shard and hash table, by cell. Names of cells are as good as random, so the
    high bits of a name tell about where it stands among them."""

    def __init__(self, cells: np.ndarray):
        """`cells`, sorted: one for each row."""
        self.starts = np.append(np.flatnonzero(np.diff(cells, prepend=cells[0] - 1)), len(cells))
        self.names = cells[self.starts[:-1]]
        self.low, self.span = self.names[0], (self.names[-1:] - self.names[0]).view(np.uint64)[0]
        bits = max(1, int(self.span).bit_length())
        self.shift = np.uint64(max(0, bits - max(1, (16 * len(self.names)).bit_length())))
        slots = self._slots(self.names)
        self.first = np.full(int(slots[-1]) + 1, -1, np.int32)
        self.first[slots[::-1]] = np.arange(len(slots))[::-1]
        self.shared = np.bincount(slots) > 1

    def _slots(self, names: np.ndarray) -> np.ndarray:
        return ((names - self.low).view(np.uint64) >> self.shift).astype(np.int64)

    def visits(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of `cells`, any number in one dimension, those that are in the shard: their places
        in `cells` and among the names."""
        near = np.flatnonzero((cells - self.low).view(np.uint64) <= self.span)
        names = cells[near]
        slots = self._slots(names)
        at = self.first[slots]
        hit = (at >= 0) & (self.names[at] == names)
        again = np.flatnonzero(~hit & self.shared[slots])
        if len(again):
            at[again] = np.searchsorted(self.names, names[again])
            hit[again] = self.names[at[again]] == names[again]
        return near[hit], at[hit]


def _meet(qids: np.ndarray, asked: np.ndarray, rows: pa.Table, tables: Tables, options: dict) -> tuple[list[Best], int]:
    """A bundle of queries against a shard: the best of each hash table, as a row found in two
    is to count once, and how many pairs were compared."""
    of_row, compared, found_in = rows["hash_table"].to_numpy(), 0, []
    for t in np.unique(of_row).tolist():
        best = Best(qids, asked, **options)
        found_in.append(best)
        mine = np.flatnonzero(of_row == t)
        part = rows.take(pa.array(mine[np.argsort(rows["cell"].to_numpy()[mine], kind="stable")]))
        shard, ids, vectors = Shard(part["cell"].to_numpy()), keys(part["id"]), narrow(part["embedding"])
        sizes, width = np.diff(shard.starts), max(1, len(asked) - 1).bit_length()
        code = np.uint32 if width + len(shard.names).bit_length() <= 32 else np.uint64
        waiting, found = ([], []), 0

        def parts(codes: np.ndarray):
            """(low, high, visitors) of every cell that is visited."""
            nonlocal compared
            if not len(codes):
                return
            codes.sort()
            codes = codes[np.diff(codes, prepend=codes[0] + 1) != 0]        # the names of two cells may be equal
            cells, visitors = (codes >> code(width)).astype(np.int32), (codes & code((1 << width) - 1)).astype(np.int32)
            del codes
            ends = np.append(np.flatnonzero(np.diff(cells, prepend=-1)), len(cells))
            compared += int(np.dot(np.diff(ends), sizes[cells[ends[:-1]]]))
            for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                c = cells[i]
                yield int(shard.starts[c]), int(shard.starts[c + 1]), visitors[i:j]

        for start in range(0, len(asked), SLICE):
            some = asked[start:start + SLICE]
            place, cell = shard.visits(tables.visited(some, t).T.ravel())
            codes = (cell.astype(code) << code(width)) | (place % len(some) + start).astype(code)
            early = np.searchsorted(place, max(1, tables.probes // FIRST) * len(some))
            for side, some_codes in zip(waiting, (codes[:early], codes[early:]), strict=True):
                side.append(some_codes)
            found += len(codes)
            if found >= VISITS or start + SLICE >= len(asked):
                for side in waiting:
                    codes = [np.concatenate(side)]
                    side.clear()
                    best.add_parts(ids, vectors, parts(codes.pop()))
                found = 0
    return found_in, compared


def search(queries: DataFrame, index: DataFrame, tables: Tables, folder: str, k: int, threshold: float | None = None,
           qid: str = "qid", vector: str = "embedding", exclude_same_id: bool = False, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(qid, id, similarity, compared): the best rows found by each task, by cosine above the
    threshold, not yet ranked; rows without qid carry the number of compared pairs."""
    spark = queries.sparkSession
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(qid).alias("qid"), F.col(vector).cast(_numbers(queries, vector)).alias("embedding"))
    schema = T.StructType([T.StructField("qid", queries.schema[qid].dataType), T.StructField("id", index.schema["id"].dataType),
                           T.StructField("similarity", T.DoubleType()), T.StructField("compared", T.LongType())])
    out = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])
    options = dict(k=k, metric="cosine", threshold=threshold, exclude_same_id=exclude_same_id)
    shards = sorted(r["shard"] for r in index.select("shard").distinct().collect())
    bundles = -(-asked.count() // query_rows)
    if not shards or not bundles:
        return spark.createDataFrame([], schema)

    def run(some: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(some) or not len(rows):
            return out.empty_table()
        best, compared = _meet(keys(some["qid"]), matrix(some["embedding"]), rows, tables, options)
        found = pa.concat_tables([b.table(pa.schema(list(out)[:3])) for b in best])
        found = found.append_column(out.field("compared"), pa.nulls(len(found), pa.int64()))
        return pa.concat_tables([found, pa.table([*(pa.nulls(1, f.type) for f in list(out)[:3]), pa.array([compared])], schema=out)])

    key = ["shard", "bundle"]
    asked = asked.withColumn("bundle", F.pmod(F.xxhash64("qid"), F.lit(bundles)).cast("int"))
    asked = asked.withColumn("shard", F.explode(F.array(*[F.lit(s) for s in shards])))
    rows = index.withColumn("bundle", F.explode(F.sequence(F.lit(0), F.lit(bundles - 1))))
    asked.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(run, schema).write.parquet(f"{folder}/found")
    return spark.read.schema(schema).parquet(f"{folder}/found")


def search_corpus(queries: DataFrame, corpus: DataFrame, k: int, threshold: float | None = None, *, qid: str = "qid", id_: str = "id",
                  vector: str = "embedding", exclude_same_id: bool = False, query_rows: int = QUERY_ROWS, **options) -> DataFrame:
    """Index a corpus and search it, in a fresh scratch folder; see `search`."""
    folder = scratch_dir(corpus.sparkSession, "buckets")
    tables = tables_for(corpus, vector, **options)
    rows = tables.tables * corpus.where(F.col(vector).isNotNull()).count()
    asked = queries.where(F.col(vector).isNotNull()).count()
    # the cells of a query are named once a shard, so shards are larger than bundles
    side = math.isqrt(rows * asked // TASKS)
    index = write_index(corpus, tables, f"{folder}/index", id_, vector, max(1, -(-rows // min(SHARD_ROWS, max(LEAST_ROWS, 2 * side)))))
    return search(queries, index, tables, folder, k, threshold, qid, vector, exclude_same_id, min(query_rows, max(LEAST_ROWS, side // 2)))
