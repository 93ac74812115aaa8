"""Prefix trie of conversations, finished in sorted shards around a broadcast skeleton.

A conversation is a path of turns. Paths are dealt into shards by splitters, sorted paths
taken from a sample, and the prefixes of the splitters form the skeleton. The members of a
node stand side by side in the order of the paths. So a node with members in two shards is
a prefix of the splitter between them: every node outside the skeleton lies in one shard,
whose sorted scan finishes it, and only the nodes of the skeleton have partial counts of
several shards to be added up.

Turns are compared by the first 128 bits of the SHA-256 of role and text.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

KEY = 16                     # bytes of a turn in a path
SHARD_ROWS = 100_000         # conversations of a shard at most, about
LEAST_ROWS = 512             # smaller shards are not made for the sake of more tasks
SAMPLED = 64                 # sampled paths for each splitter
SKELETON_TURNS = 4096        # turns of a splitter that count; conversations alike in more share a shard
FLUSH = 20_000               # rows handed on at once
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

# Rows of a scan. number >= 0: part of a skeleton node; -1: a finished node, whose parent
# is a conversation or a skeleton node still to be named.
SCANNED = ("number int, shard int, conv_id long, depth long, parent_conv_id long, parent_number int, n_convs long, "
           "n_children long, n_leaves long, saved_tokens long, size long, ends string")
_SKELETON = "number int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def turn_key(role: Column, text: Column) -> Column:
    """Hex name of a turn; roles and texts that differ never share one, but for a
    collision of 128 bits of SHA-256."""
    return F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * KEY)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): array<struct<key, size>> by turn, null first, then role and text.

    Every row is a turn, so repeated rows are repeated turns. Null role or text is empty.
    Rows without conv_id belong to no conversation and are left out, as are other columns."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", role.alias("role"), text.alias("text"))
    # the window sorts with spilling; what is gathered into a row is only keys and sizes
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    rows = rows.select("conv_id", place.alias("place"), turn_key(F.col("role"), F.col("text")).alias("key"),
                       F.length("text").alias("size"))
    turns = F.array_sort(F.collect_list(F.struct("place", "key", "size")))
    return rows.groupBy("conv_id").agg(turns.alias("turns")).select(
        "conv_id", F.transform("turns", lambda t: F.struct(t["key"].alias("key"), t["size"].alias("size"))).alias("turns"))


class Skeleton:
    """The trie of the splitters. Numbers are given in the order of the paths, a node
    before its children; 0 is the root."""

    def __init__(self, paths: list[bytes]):
        self.child: dict[tuple[int, bytes], int] = {}
        self.parent, self.depth = [-1], [0]
        for path in sorted(paths):
            node = 0
            for i in range(0, len(path), KEY):
                step = (node, path[i:i + KEY])
                if step not in self.child:
                    self.child[step] = len(self.parent)
                    self.parent.append(node)
                    self.depth.append(i // KEY + 1)
                node = self.child[step]


class _Node:
    __slots__ = ("number", "size", "n", "low", "kids", "leaves", "saved", "ends", "waiting")

    def __init__(self, number: int, size: int):
        self.number, self.size, self.n, self.low = number, size, 0, None
        self.kids = self.leaves = self.saved = 0
        self.ends: list[int] = []
        self.waiting: list[list] = []       # finished children, until the smallest member of this node is known


class Scan:
    """One pass over the sorted paths of a shard. The stack holds the nodes of the
    current path; a node that is left behind is finished."""

    def __init__(self, skeleton: Skeleton, shard: int):
        self.skeleton, self.shard, self.rows = skeleton, shard, []
        self.stack, self.path = [_Node(0, 0)], b""

    def add(self, path: bytes, sizes, conv_id: int) -> None:
        common, most = 0, min(len(path), len(self.path))
        while common < most and path[common:common + KEY] == self.path[common:common + KEY]:
            common += KEY
        while len(self.stack) > common // KEY + 1:
            self._close()
        child = self.skeleton.child
        for i in range(common, len(path), KEY):
            above = self.stack[-1].number
            self.stack.append(_Node(child.get((above, path[i:i + KEY]), -1) if above >= 0 else -1, sizes[i // KEY]))
        self.stack[-1].ends.append(conv_id)
        self.path = path

    def _close(self) -> None:
        node, depth = self.stack.pop(), len(self.stack)
        if node.ends:
            node.n += len(node.ends)
            node.low = min(node.ends) if node.low is None else min(node.low, min(node.ends))
        ends = ",".join(map(str, sorted(node.ends)))
        if node.number >= 0:
            for row in node.waiting:
                row[5] = node.number
            self.rows += node.waiting
            self.rows.append([node.number, self.shard, node.low, depth, None, None, node.n, node.kids, node.leaves,
                              node.saved, node.size, ends])
            return
        for row in node.waiting:
            row[4] = node.low
        self.rows += node.waiting
        leaves, saved = node.leaves or 1, node.saved + (node.n - 1) * node.size
        above = self.stack[-1]
        above.waiting.append([-1, self.shard, node.low, depth, None, None, node.n, node.kids, leaves, saved, node.size,
                              hashlib.sha256(ends.encode()).hexdigest()])
        above.kids, above.leaves, above.saved, above.n = above.kids + 1, above.leaves + leaves, above.saved + saved, above.n + node.n
        above.low = node.low if above.low is None else min(above.low, node.low)

    def finish(self) -> None:
        while self.stack:
            self._close()


def _batch(rows: list[list]) -> pa.RecordBatch:
    fields = [c.split() for c in SCANNED.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([row[i] for row in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)],
                                      [name for name, _ in fields])


def _splitters(paths: DataFrame, n: int) -> list[tuple[bytes, int]]:
    """Sorted (path, conv_id) that part the conversations into even shards. At most
    SAMPLED rows a shard are sorted for it, and one of a shard comes back."""
    partitions = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(-(-n // SHARD_ROWS), min(partitions, -(-n // LEAST_ROWS)))
    if shards < 2:
        return []
    every = max(1, n // (SAMPLED * shards))
    tiles = paths.where(F.pmod(F.xxhash64("conv_id"), F.lit(every)) == 0).select(
        "path", "conv_id", F.ntile(shards).over(Window.orderBy("path", "conv_id")).alias("tile"))
    first = tiles.where("tile > 1").groupBy("tile").agg(F.min(F.struct("path", "conv_id")).alias("first"))
    cut = first.select(F.substring("first.path", 1, KEY * SKELETON_TURNS).alias("path"), "first.conv_id")
    return sorted({(bytes(r["path"]), r["conv_id"]) for r in cut.collect()})


def _scanned(spark: SparkSession, paths: DataFrame, splitters: list[tuple[bytes, int]], skeleton) -> DataFrame:
    sent = spark.sparkContext.broadcast(splitters)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch["conv_id"].to_pylist(), batch["path"].to_pylist()
            shard = [bisect_right(sent.value, pair) for pair in zip(keys, ids, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), *batch.columns], ["shard", *batch.schema.names])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = None
        for batch in batches:
            for shard, conv_id, path, sizes in zip(*(batch[c].to_pylist() for c in ("shard", "conv_id", "path", "sizes")), strict=True):
                if current is None or current.shard != shard:
                    rows = []
                    if current is not None:
                        current.finish()
                        rows = current.rows
                    current = Scan(skeleton.value, shard)
                    current.rows = rows
                current.add(path, sizes, conv_id)
                if len(current.rows) >= FLUSH:
                    yield _batch(current.rows)
                    current.rows = []
        if current is not None:
            current.finish()
            yield _batch(current.rows)

    dealt = paths.mapInArrow(deal, "shard int, conv_id long, path binary, sizes array<int>")
    return dealt.repartition("shard").sortWithinPartitions("shard", "path", "conv_id").mapInArrow(scan, SCANNED)


def _joined_hashes(parts: DataFrame) -> DataFrame:
    """(number, ends_sha256): the lists of a node's shards, one after the other. SHA-256
    has no partial form; the lists pass through it in a stream, a row for each shard."""
    def hashes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, digest = None, None
        for frame in frames:
            for k, ends in zip(frame["number"], frame["ends"], strict=True):
                if k != number:
                    if number is not None:
                        yield pd.DataFrame({"number": np.array([number], np.int32), "ends_sha256": [digest.hexdigest()]})
                    number, digest = k, hashlib.sha256(ends.encode())
                else:
                    digest.update(b"," + ends.encode())
        if number is not None:
            yield pd.DataFrame({"number": np.array([number], np.int32), "ends_sha256": [digest.hexdigest()]})

    lists = parts.where("ends <> ''").select("number", "shard", "ends")
    return lists.repartition("number").sortWithinPartitions("number", "shard").mapInPandas(hashes, "number int, ends_sha256 string")


def _reduced(parts: DataFrame, skeleton) -> DataFrame:
    """Skeleton nodes: the parts of all shards added up, then from the last node to the
    root. There are at most SKELETON_TURNS of them for a shard, so one task finishes them."""
    sums = parts.groupBy("number").agg(       # a part without members of its own has no smallest one
        F.coalesce(F.min("conv_id"), F.lit(2 ** 63 - 1)).alias("conv_id"), F.max("size").alias("size"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])

    def climb(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [f for f in frames if len(f)]
        if not frames:
            return
        nodes = pd.concat(frames).sort_values("number")
        numbers = nodes["number"].to_numpy()
        parent, depth = np.array(skeleton.value.parent)[numbers], np.array(skeleton.value.depth)[numbers]
        at = {int(k): i for i, k in enumerate(numbers)}
        low, size, n, kids, leaves, saved = (nodes[c].to_numpy(np.int64).copy() for c in (
            "conv_id", "size", "n_convs", "n_children", "n_leaves", "saved_tokens"))
        above = [at.get(int(p), -1) for p in parent]
        for i in range(len(nodes) - 1, -1, -1):
            leaves[i] = leaves[i] or 1
            saved[i] += (n[i] - 1) * size[i]
            if (p := above[i]) >= 0:
                n[p], kids[p], leaves[p], saved[p] = n[p] + n[i], kids[p] + 1, leaves[p] + leaves[i], saved[p] + saved[i]
                low[p] = min(low[p], low[i])
        yield pd.DataFrame({"number": numbers, "conv_id": low, "depth": depth,
                            "parent_conv_id": pd.array([low[p] if p >= 0 else None for p in above], "Int64"),
                            "n_convs": n, "n_children": kids, "n_leaves": leaves, "saved_tokens": saved})

    return sums.coalesce(1).mapInPandas(climb, _SKELETON)


def prefix_trie(conversations: DataFrame, folder: str) -> DataFrame:
    """conversations(conv_id, turns array<struct<key, size>>), one row each, as trie nodes
    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256): the smallest member and the depth name a node, ends_sha256 is of the
    ids that end there.

    A conversation without turns is a member of the root. No conversation, no node, not
    even the root. A conversation is one row and has to fit a task; equal and common
    conversations are spread over shards by conv_id. `folder`: shared, for the paths and
    for what the shards have found."""
    spark = conversations.sparkSession
    conversations.select("conv_id", F.unhex(F.array_join("turns.key", "")).alias("path"), F.col("turns.size").alias("sizes")
                         ).write.parquet(f"{folder}/paths")
    paths = spark.read.parquet(f"{folder}/paths")
    splitters = _splitters(paths, paths.count())
    skeleton = spark.sparkContext.broadcast(Skeleton([path for path, _ in splitters]))
    _scanned(spark, paths, splitters, skeleton).write.parquet(f"{folder}/scanned")
    scanned = spark.read.parquet(f"{folder}/scanned")
    parts = scanned.where("number >= 0")
    _reduced(parts, skeleton).join(_joined_hashes(parts), "number", "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_SHA))).write.parquet(f"{folder}/skeleton")
    upper = spark.read.parquet(f"{folder}/skeleton")
    shown = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    # the skeleton is bounded by the shards, so its names go to all nodes below it
    names = F.broadcast(upper.select(F.col("number").alias("parent_number"), F.col("conv_id").alias("_above")))
    lower = scanned.where("number < 0").join(names, "parent_number", "left").withColumn(
        "parent_conv_id", F.coalesce("parent_conv_id", "_above")).withColumnRenamed("ends", "ends_sha256")
    return lower.select(*shown).unionByName(upper.select(*shown))
