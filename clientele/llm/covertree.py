"""Near-duplicate vectors by a dual traversal of cover trees.

Vectors are normalised, so cosine >= t is a distance of at most sqrt(2 - 2t). Cells are
the top nodes; each holds a cover tree of bounded size whose levels have halving radii
and whose nodes know their covering radius. Two nodes are compared only if the distance
of their centres does not exceed both radii plus the threshold; if it is so small that
all their points must lie within the threshold, they are linked without looking further.
What remains is decided by the cosine itself, in double precision.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from clientele.llm.graph import components
from clientele.llm.vectors import matrix, usable, widest
from clientele.session import scratch_dir

CELL_VECTORS = 4096                    # vectors of a cell, about
CENTRES = 4096                         # at most so many cells; larger ones are dealt into parts
RADII = (0.5, 0.25, 0.125)             # of the levels below a cell
SLACK = 1e-5                           # bounds are worked out in single precision
_BLOCK = 1024


class Tree:
    """Points in tree order; level l has nodes [start, stop) with a centre and the exact
    covering radius. The last level is the points themselves."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, weights: np.ndarray):
        order = np.arange(len(points))
        borders = [np.array([0, len(points)])]
        for radius in RADII:
            order, border = self._split(points, order, borders[-1], radius)
            borders.append(border)
        self.points, self.ids, self.weights = points[order], ids[order], weights[order]
        self.order, self.levels = order, []
        for border in borders:
            start, stop = border[:-1], border[1:]
            centre = self.points[start]
            far = 1 - np.einsum("ij,ij->i", self.points, np.repeat(centre, stop - start, axis=0))
            radius = np.sqrt(np.maximum(2 * np.maximum.reduceat(far, start), 0)) if len(start) else far
            radius = np.where(stop - start == 1, 0.0, radius)
            self.levels.append((start, stop, radius))
        line = np.arange(len(points))
        self.levels.append((line, line + 1, np.zeros(len(points))))
        self.small = self.points.astype(np.float32)

    def packed(self, raw: np.ndarray) -> bytes:
        """With the vectors as they came, in single precision where that holds them."""
        raw, short = raw[self.order], raw[self.order].astype(np.float32)
        return pickle.dumps((short if np.array_equal(short, raw) else raw, self.ids, self.weights, self.levels), 5)

    @staticmethod
    def unpacked(data: bytes) -> "Tree":
        tree = Tree.__new__(Tree)
        raw, tree.ids, tree.weights, tree.levels = pickle.loads(data)
        tree.points = _unit(raw.astype(np.float64))
        tree.small = tree.points.astype(np.float32)
        return tree

    @staticmethod
    def _split(points, order, border, radius):
        """Cut every node into a net: centres further apart than the radius, each with
        the points of the node that it reaches first."""
        new, cuts, least = [], [0], 1 - radius * radius / 2
        points = points.astype(np.float32)
        for a, b in zip(border[:-1], border[1:], strict=True):
            rest = order[a:b]
            near = points[rest] @ points[rest].T >= least if b - a > 1 else np.ones((1, 1), bool)
            free = np.ones(b - a, bool)
            for i in range(b - a):
                if free[i]:
                    own = np.flatnonzero(near[i] & free)
                    own = np.concatenate([[i], own[own != i]])          # the centre comes first
                    free[own] = False
                    new.append(rest[own])
                    cuts.append(cuts[-1] + len(own))
        return (np.concatenate(new) if new else order), np.array(cuts)


def _children(level, k: np.ndarray):
    """For nodes k of a level, the range of their parts on the next one."""
    (start, stop, _), (below, _, _) = level
    return np.searchsorted(below, start[k]), np.searchsorted(below, stop[k])


def _expand(a0, a1, b0, b1):
    """All pairs of a in [a0, a1) and b in [b0, b1) of each row."""
    wide = b1 - b0
    count = (a1 - a0) * wide
    row = np.repeat(np.arange(len(count)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return a0[row] + k // wide[row], b0[row] + k % wide[row]


def links(one: Tree, two: Tree, same: bool, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(i, j): point pairs of both trees with cosine >= limit, and (p, q): pairs of nodes
    as (start, stop) rows that are linked as a whole. `same`: i < j only."""
    reach = np.sqrt(2 - 2 * limit)
    found_i, found_j, whole = [], [], []

    def keep(level, a, b):
        """Drop node pairs that cannot link; set aside those that link as a whole."""
        (s1, e1, r1), (s2, e2, r2) = one.levels[level], two.levels[level]
        if same:
            a, b = a[a <= b], b[a <= b]
        cosine = np.einsum("ij,ij->i", one.small[s1[a]], two.small[s2[b]]).astype(np.float64)
        distance = np.sqrt(np.maximum(2 - 2 * cosine, 0))
        both = r1[a] + r2[b]
        near = distance <= both + reach + np.sqrt(SLACK)
        sure = near & (distance + both <= reach - np.sqrt(SLACK)) & ((e1 - s1)[a] * (e2 - s2)[b] > 1) & ~(same & (a == b))
        whole.append(np.column_stack([s1[a[sure]], e1[a[sure]], s2[b[sure]], e2[b[sure]]]))
        near &= ~sure
        return a[near], b[near]

    # The first level below a cell has most nodes: whole blocks of centres at once, the
    # single points among them first, as they need no bound of their own.
    (s1, _, r1), (s2, _, r2) = one.levels[1], two.levels[1]
    rank1, rank2, first = np.argsort(r1, kind="stable"), np.argsort(r2, kind="stable"), []
    for x in range(0, len(s1), _BLOCK):
        a = rank1[x:x + _BLOCK]
        for y in range(x if same else 0, len(s2), _BLOCK):
            b = rank2[y:y + _BLOCK]
            cosine = one.small[s1[a]] @ two.small[s2[b]].T
            if r1[a[-1]] + r2[b[-1]] > 0:
                cosine += (np.minimum(r1[a][:, None] + r2[b][None] + reach, 2) ** 2 / 2).astype(np.float32)
                i, j = np.nonzero(cosine >= 1 - SLACK)
            else:
                i, j = np.nonzero(cosine >= limit - SLACK)
            if same and x == y:
                i, j = i[i <= j], j[i <= j]
            i, j = a[i], b[j]
            first.append((np.minimum(i, j), np.maximum(i, j)) if same else (i, j))
    a, b = np.concatenate([f[0] for f in first]), np.concatenate([f[1] for f in first])
    a, b = keep(1, a, b)
    for level in range(1, len(one.levels) - 1):
        if not len(a):
            break
        # a part of the frontier at a time bounds the memory
        sizes = (np.subtract(*_children(one.levels[level:level + 2], a)[::-1])
                 * np.subtract(*_children(two.levels[level:level + 2], b)[::-1]))
        parts = np.flatnonzero(np.diff(np.cumsum(sizes) // (1 << 20), prepend=-1))
        nexts = []
        for lo, hi in zip(parts, [*parts[1:], len(a)], strict=True):
            x, y = _expand(*_children(one.levels[level:level + 2], a[lo:hi]), *_children(two.levels[level:level + 2], b[lo:hi]))
            nexts.append(keep(level + 1, x, y))
        a, b = (np.concatenate([n[side] for n in nexts]) for side in (0, 1))
    for lo in range(0, len(a), 1 << 18):
        i, j = a[lo:lo + (1 << 18)], b[lo:lo + (1 << 18)]
        if same:
            i, j = i[i < j], j[i < j]
        exact = np.einsum("ij,ij->i", one.points[i], two.points[j]) >= limit
        found_i.append(i[exact])
        found_j.append(j[exact])
    blocks = np.concatenate(whole)
    none = np.zeros(0, np.int64)
    return (np.concatenate(found_i) if found_i else none, np.concatenate(found_j) if found_j else none,
            blocks[:, :2], blocks[:, 2:])


def _joined(one: Tree, two: Tree, same: bool, limit: float) -> pd.DataFrame:
    """Per vector of both trees: how many others it links with here, and one vector that
    stands for those it is connected with here."""
    i, j, p, q = links(one, two, same, limit)
    shift = 0 if same else len(one.ids)
    ids = one.ids if same else np.concatenate([one.ids, two.ids])
    w1, w2 = one.weights.astype(float), two.weights.astype(float)
    # without a link bincount would count in whole numbers
    n = np.bincount(i, w2[j], len(ids)).astype(float) + np.bincount(j + shift, w1[i], len(ids))
    for (a0, a1), (b0, b1) in zip(p, q, strict=True):
        n[a0:a1] += w2[b0:b1].sum()
        n[b0 + shift:b1 + shift] += w1[a0:a1].sum()
    # a whole block is connected through its first points
    ends = [(np.arange(a0, a1), np.full(a1 - a0, b0)) for (a0, a1), (b0, _) in zip(p, q, strict=True)]
    ends += [(np.full(b1 - b0, a0), np.arange(b0, b1)) for (a0, _), (b0, b1) in zip(p, q, strict=True)]
    i = np.concatenate([i, *[e[0] for e in ends]]).astype(np.int64)
    j = np.concatenate([j, *[e[1] for e in ends]]).astype(np.int64) + shift
    label = np.arange(len(ids))
    while True:
        least = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        np.minimum.at(label, before[i], least)
        np.minimum.at(label, before[j], least)
        label = label[label]
        if np.array_equal(label, before):
            break
    has = np.flatnonzero((n > 0) | (label != np.arange(len(ids))))
    return pd.DataFrame({"vec_id": ids[has], "n": n[has].astype(np.int64), "other": ids[label[has]]})


def near_vectors(vectors: DataFrame, limit: float = 0.95, cell_vectors: int = CELL_VECTORS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors(vec_id, embedding).

    Null, zero and unfinished vectors, and those of another length than most, link with
    nothing. Equal vectors stand for one with a weight. Repeated vec_ids are expected to
    hold the same vector; they count as links of each other and give a row each. Rows
    without vec_id link with nothing. No row gives no row; other columns are left out.
    Centres are at most CENTRES vectors, chosen by a hash; they decide about the cells
    only, never about the links."""
    spark, folder = vectors.sparkSession, scratch_dir(vectors.sparkSession, "cover")
    vectors = vectors.select("vec_id", "embedding")
    width, reach = widest(vectors), float(np.sqrt(2 - 2 * limit))
    good = vectors.where(usable() & (F.size("embedding") == width) & F.col("vec_id").isNotNull()).select(
        "vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    # equal vectors: one of them goes on, with the number of them all
    groups = good.groupBy("embedding").agg(F.min("vec_id").alias("head"), F.count("*").alias("weight"))
    groups.write.parquet(f"{folder}/groups")
    groups = spark.read.parquet(f"{folder}/groups")
    total = groups.count()
    n_cells = min(CENTRES, max(1, -(-total // cell_vectors)))
    sample = groups.orderBy(F.xxhash64("head"), "head").limit(n_cells).select("embedding").toPandas()
    centres = _unit(matrix(sample["embedding"])) if total else np.zeros((0, width))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = matrix(batch["embedding"])
            cosine = _unit(raw) @ centres.T if len(raw) else np.zeros((0, 1))
            yield pd.DataFrame({"cell": cosine.argmax(axis=1), "far": np.sqrt(np.maximum(2 - 2 * cosine.max(axis=1), 0)),
                                "head": batch["head"], "weight": batch["weight"], "raw": [p.tobytes() for p in raw]})

    groups.select("embedding", "head", "weight").mapInPandas(
        place, "cell long, far double, head long, weight long, raw binary").write.parquet(f"{folder}/placed")
    placed = spark.read.parquet(f"{folder}/placed")
    # a cell that many vectors share is dealt into parts, and parts meet like cells
    cells = placed.groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n")).withColumn(
        "parts", F.ceil(F.col("n") / cell_vectors))
    placed = placed.join(F.broadcast(cells.select("cell", "parts")), "cell").withColumn(
        "part", F.pmod(F.xxhash64("head"), F.col("parts")))

    def grow(keys, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("head")
        raw = np.stack([np.frombuffer(p) for p in frame["raw"]])
        tree = Tree(_unit(raw), frame["head"].to_numpy(), frame["weight"].to_numpy())
        return pd.DataFrame({"cell": [keys[0]], "part": [keys[1]], "tree": [tree.packed(raw)]})

    placed.groupBy("cell", "part").applyInPandas(
        grow, "cell long, part long, tree binary").write.parquet(f"{folder}/trees")
    trees = spark.read.parquet(f"{folder}/trees")
    # top of the traversal: cells whose balls come within reach; there are CENTRES at most
    pairs = spark.createDataFrame(_near_cells(centres, cells.toPandas(), reach + 1e-6), "a long, b long")
    parts = trees.select("cell", "part")
    met = pairs.join(parts.toDF("a", "part_a"), "a").join(parts.toDF("b", "part_b"), "b").where(
        "a < b or part_a <= part_b")
    met = met.join(trees.toDF("a", "part_a", "one"), ["a", "part_a"]).join(
        trees.toDF("b", "part_b", "two"), ["b", "part_b"])
    met = met.select(((F.col("a") == F.col("b")) & (F.col("part_a") == F.col("part_b"))).alias("same"), "one", "two")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for same, one, two in batch.itertuples(index=False, name=None):
                left = Tree.unpacked(one)
                yield _joined(left, left if same else Tree.unpacked(two), same, limit)

    met.mapInPandas(compare, "vec_id long, n long, other long").write.parquet(f"{folder}/links")
    found = spark.read.parquet(f"{folder}/links")
    counts = found.groupBy(F.col("vec_id").alias("head")).agg(F.sum("n").alias("n"))
    joined = components(found.select(F.col("vec_id").alias("a"), F.col("other").alias("b")), "cover-components")
    heads = groups.select("head", "embedding", "weight").join(counts, "head", "left").join(
        joined.select(F.col("id").alias("head"), "component"), "head", "left").select(
        "embedding", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component", "head").alias("component_id"))
    rows = vectors.withColumn("key", F.when(usable() & F.col("vec_id").isNotNull(), F.col("embedding").cast("array<double>")))
    out = rows.join(heads.withColumnRenamed("embedding", "key"), "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _unit(points: np.ndarray) -> np.ndarray:
    return points / np.linalg.norm(points, axis=1, keepdims=True) if len(points) else points


def _near_cells(centres: np.ndarray, cells: pd.DataFrame, reach: float) -> list[tuple[int, int]]:
    """Pairs (a, b), a <= b, of cells that may hold a link."""
    number, radius, found = cells["cell"].to_numpy(), cells["radius"].to_numpy(), []
    points = centres[number]
    for k, (a, r) in enumerate(zip(number, radius, strict=True)):
        far = np.linalg.norm(points - points[k], axis=1)
        near = number[(far <= r + radius + reach) & (number >= a)]
        found += [(int(a), int(b)) for b in near]
    return found
