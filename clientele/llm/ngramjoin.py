"""Jaccard join on word shingles with count-vector R-trees.

The shingles of a text are hashed into GROUPS groups; the group counts are its point.
Two texts share at most the sum of the smaller counts of each group, and the larger
corners of two boxes bound all pairs below them in the same way.

A global R-tree over such points cannot part texts of like length (every box reaches
every other, see the README), so space is first cut into cells: a text is entered for
each of its rarest shingles, as many as a linked text cannot miss all of. A cell
that the first round leaves in parts gets a tree of one level of leaves, packed by size. Pairs whose bound survives are verified on whole
shingle sets. Texts with equal sets are one node throughout.

In a first round every member of a cell meets one other only, its head. Cells whose
members are then all connected are done; in the others the trees find every further pair
between parts that are not connected yet. No link between parts is lost, and a group of
near copies costs its size, not the square of it. Links within a part are not all looked for,
so they are not counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from clientele.llm import textscan
from clientele.llm.graph import components

WORDS = 4
SHARED, OF = 85, 100              # OF * intersection >= SHARED * union
GROUPS = 256                      # counts are bytes; FULL stands for "so many or more"
FULL = 255
LEAF = 32                         # points of a leaf
CELL_BLOCK = 4096                 # members of a cell that one task holds; more are dealt
FREQUENT = 1 << 16                # most frequent shingles that come last in the order
SEEN = 4                          # how often in a batch a shingle must come to be counted
SENT_ROWS = 4_000_000             # rows of an id list that are sent to the texts at most
BATCH = 1 << 20
PIVOT_MEMBERS = 512               # texts that one copy of a head is held against
_U = np.uint64


def shingle_sets(texts) -> Iterator[np.ndarray]:
    """The distinct shingles of each text, sorted; null and empty texts have none."""
    sizes = [len(t) if isinstance(t, str) else 0 for t in texts]
    for a, b in textscan.batches(sizes, BATCH):
        words, first = textscan.word_hashes(textscan.utf8(texts[a:b]), lower=True)
        counts = np.diff(first)
        # runs over all words at once; those that leave their text are not taken
        runs = textscan.shingle_hashes(words, WORDS) if len(words) >= WORDS else words[:0]
        for d, (start, n) in enumerate(zip(first[:-1], counts, strict=True)):
            if n >= WORDS:
                yield np.unique(runs[start:start + n - WORDS + 1])
            else:
                yield textscan.shingle_hashes(words[start:start + n], WORDS)


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Shingles of many documents, at most FREQUENT of them. They only decide which
    shingles of a text count as rare, never what is linked."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in textscan.batches([len(t) if isinstance(t, str) else 0 for t in texts], 2 * BATCH):
                sets = list(shingle_sets(texts[a:b]))
                if sets:
                    shingle, n = np.unique(np.concatenate(sets), return_counts=True)
                    yield pd.DataFrame({"shingle": shingle[n >= SEEN].view(np.int64), "n": n[n >= SEEN]})

    found = docs.select("text").mapInPandas(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = found.orderBy(F.desc("n"), "shingle").limit(FREQUENT).toPandas()
    return np.sort(top["shingle"].to_numpy(np.int64).view(_U))


def profile(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """docs and the column j: struct of row (unique), n (size of the set), node (one per
    distinct set), keys (the shingles it is entered for) and counts (its point)."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    @F.pandas_udf("row long, n int, node long, keys array<long>, counts binary")
    def make(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        common, row = sent.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            out = []
            for s in shingle_sets(batch.tolist()):
                prefix = len(s) - -(-SHARED * len(s) // OF) + 1 if len(s) else 0
                at = np.searchsorted(common, s)
                late = common[np.minimum(at, len(common) - 1)] == s if len(common) else np.zeros(len(s), bool)
                # one order for all: the infrequent by hash, then the frequent by hash
                keys = np.concatenate([s[~late][:prefix], s[late][:max(0, prefix - int((~late).sum()))]])
                node = textscan.mix(np.array([np.bitwise_xor.reduce(textscan.mix(s)) + _U(len(s))], _U))[0] if len(s) else _U(0)
                counts = np.minimum(np.bincount((s % _U(GROUPS)).astype(np.int64), minlength=GROUPS), FULL).astype(np.uint8)
                out.append((row, len(s), int(np.int64(node)), keys.view(np.int64), counts.tobytes()))
                row += 1
            yield pd.DataFrame(out, columns=["row", "n", "node", "keys", "counts"])
    return docs.withColumn("j", make("text"))


def _shared_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows (key, id, n) sorted by key and id: those whose key another row has, with
    the first id of the key as its head."""
    rest, head = None, None
    for batch in batches:
        frame = batch if rest is None else pd.concat([rest, batch])
        yield from _shared(frame.iloc[:-1], frame, head)
        key = frame["key"].to_numpy()
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))[-1]
        old = head if head is not None and head[0] == key[-1] else None
        head = old or (key[-1], frame["id"].iloc[start], frame["n"].iloc[start], start < len(frame) - 1)
        if head[3] is False and start < len(frame) - 1:
            head = (*head[:3], True)
        rest = frame.iloc[-1:]
    if rest is not None:
        yield from _shared(rest, rest, head)


def _shared(out: pd.DataFrame, frame: pd.DataFrame, head) -> Iterator[pd.DataFrame]:
    if not len(out):
        return
    key, ids, n = (frame[c].to_numpy() for c in ("key", "id", "n"))
    new = np.append(True, key[1:] != key[:-1])
    at = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    first, size = ids[at], n[at]
    alone = new & np.append(new[1:], True)
    if head is not None and head[0] == key[0]:
        mine = at == 0
        first, size = np.where(mine, head[1], first), np.where(mine, head[2], size)
        alone &= ~(mine & (head[3] | (ids != head[1])))
    take = np.flatnonzero(~alone[:len(out)])
    yield pd.DataFrame({"key": key[take], "id": ids[take], "n": n[take], "head": first[take], "head_n": size[take]})


def _may_link(n_a, n_b, shared) -> np.ndarray:
    """Whether sets of these sizes that share so much at most can be linked."""
    small, large = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    shared = np.minimum(shared, small)
    return (OF * small >= SHARED * large) & (OF * shared >= SHARED * (n_a + n_b - shared))


_LANES = _U(0x00FF00FF00FF00FF)


def _points(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, GROUPS)


def _most_shared(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Sums of the smaller counts along the last axis; boundless where a group is full
    on both sides. Bytes are added eight at a time."""
    least = np.ascontiguousarray(np.minimum(one, two))
    words = least.view(_U)
    sums = ((words & _LANES) + (words >> _U(8) & _LANES)).sum(axis=-1)
    total = sum((sums >> _U(k) & _U(0xFFFF)).astype(np.int64) for k in (0, 16, 32, 48))
    if one.max(initial=0) == FULL and two.max(initial=0) == FULL:
        total = np.where((least == FULL).any(axis=-1), 1 << 40, total)
    return total


def bounded(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Pairs (a, b) whose bound allows a link; points: (id, n, counts)."""
    both = pairs.join(points.toDF("a", "n_a", "one"), "a").join(points.toDF("b", "n_b", "two"), "b")

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                ok = _may_link(batch["n_a"].to_numpy(np.int64), batch["n_b"].to_numpy(np.int64),
                               _most_shared(_points(batch["one"]), _points(batch["two"])))
                yield batch.loc[ok, ["a", "b"]]
    return both.select("a", "b", "n_a", "n_b", "one", "two").mapInPandas(test, "a long, b long")


class Tree:
    """An R-tree packed by size: leaves of LEAF points, boxes known by their larger
    corner and their range of sizes."""

    def __init__(self, ids, part, n, counts):
        order = np.argsort(n, kind="stable")
        self.ids, self.part, self.n, self.counts = ids[order], part[order], n[order], counts[order]
        self.start = np.arange(0, len(ids), LEAF)
        self.low, self.high = self.n[self.start], np.maximum.reduceat(self.n, self.start)
        self.corner = np.maximum.reduceat(self.counts, self.start, axis=0)

    def pairs(self, other: "Tree") -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of points of both trees in different parts that may be linked."""
        same = other is self
        for k, start in enumerate(self.start):
            leaves = np.arange(k if same else 0, len(other.start))
            shared = _most_shared(self.corner[k], other.corner[leaves])
            # the least total size of a pair, and sizes that can agree at all
            fits = ((OF + SHARED) * shared >= SHARED * (self.low[k] + other.low[leaves])) \
                & (OF * other.high[leaves] >= SHARED * self.low[k]) & (OF * self.high[k] >= SHARED * other.low[leaves])
            mine = slice(start, start + LEAF)
            for leaf in leaves[fits]:
                at = other.start[leaf]
                theirs = slice(at, at + LEAF)
                shared = _most_shared(self.counts[mine, None], other.counts[None, theirs])
                ok = _may_link(self.n[mine, None], other.n[None, theirs], shared) & (
                    self.part[mine, None] != other.part[None, theirs])
                if same and leaf == k:
                    ok = np.triu(ok, 1)
                i, j = np.nonzero(ok)
                if len(i):
                    yield self.ids[mine][i], other.ids[theirs][j]


def _cell_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Candidate pairs of rows (head, low, high, block, id, n, part, keys, counts) sorted
    by head, low and high: members of the cells of one head, within a block or between
    two. Cells with one head have much the same members, so each pair comes out once."""
    def solve(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        ids, part, n, block = (frame[c].to_numpy() for c in ("id", "part", "n", "block"))
        counts, low, high = _points(frame["counts"]), frame["low"].iloc[0], frame["high"].iloc[0]

        def tree(at) -> Tree:
            return Tree(ids[at], part[at], n[at].astype(np.int64), counts[at])
        if low != high:
            sides = [np.flatnonzero(block == side) for side in (low, high)]
            found = list(tree(sides[0]).pairs(tree(sides[1]))) if len(sides[0]) and len(sides[1]) else []
        else:
            row = np.repeat(np.arange(len(frame)), frame["keys"].str.len())
            key, at, size = np.unique(np.concatenate(frame["keys"].tolist()), return_inverse=True, return_counts=True)
            if len(frame) ** 2 <= (size.astype(float) ** 2).sum():
                cells = [np.arange(len(frame))]          # all members at once are less work than cell by cell
            else:
                cells = np.split(row[np.argsort(at, kind="stable")], np.cumsum(size)[:-1])
            found = []
            for cell in cells:
                if len(cell) > 1 and (part[cell] != part[cell[0]]).any():
                    whole = tree(cell)
                    found += whole.pairs(whole)
        if found:
            a, b = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
            pairs = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0)
            yield pd.DataFrame(pairs, columns=["a", "b"])

    rest = []
    for batch in batches:
        if not len(batch):
            continue
        cell = batch[["head", "low", "high"]].to_numpy()
        cuts = np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1
        if rest and (rest[0][["head", "low", "high"]].iloc[0].to_numpy() != cell[0]).any():
            yield from solve(pd.concat(rest))
            rest = []
        borders = [0, *cuts.tolist(), len(batch)]
        for x, y in zip(borders[:-1], borders[1:], strict=True):
            rest.append(batch.iloc[x:y])
            if y < len(batch):
                yield from solve(pd.concat(rest))
                rest = []
    if rest:
        yield from solve(pd.concat(rest))


def _sent(small: DataFrame) -> DataFrame:
    """A list of ids goes to all tasks if it has SENT_ROWS rows at most; a longer one
    meets the other side in a shuffle. Both give the same rows."""
    return F.broadcast(small) if small.limit(SENT_ROWS + 1).count() <= SENT_ROWS else small


def _texts_of(pairs: DataFrame, nodes: DataFrame, table: DataFrame) -> DataFrame:
    need = nodes.join(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "node")
    return table.join(_sent(need), "row").select("node", "text")


def _against_heads(pairs: DataFrame, data: DataFrame, column: str, test) -> DataFrame:
    """Pairs (a, b) whose data(node, column) pass `test`, a generator over batches of
    (a, role, b, column) in which the row of a head (role 0) comes before its members.
    A head with many members is dealt into copies, so each side travels once per pair
    at most and no task holds more than a head and a batch."""
    degree = pairs.groupBy("a").agg(F.ceil(F.count("*") / PIVOT_MEMBERS).alias("copies"))
    heads = degree.join(data.withColumnRenamed("node", "a"), "a").select(
        "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("role"),
        F.col("a").alias("b"), column)
    members = pairs.join(degree, "a").select("a", "b", F.pmod(F.xxhash64("b"), "copies").alias("copy")).join(
        data.withColumnRenamed("node", "b"), "b").select("a", "copy", F.lit(1).alias("role"), "b", column)
    return heads.unionByName(members).repartition("a", "copy").sortWithinPartitions("a", "copy", "role").select(
        "a", "role", "b", column).mapInPandas(test, "a long, b long")


def _tested(read, enough):
    """A test for _against_heads: `read` makes arrays of distinct numbers of a batch."""
    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head = None
        for batch in batches:
            links = []
            for a, role, b, own in zip(batch["a"], batch["role"], batch["b"], read(batch.iloc[:, 3]), strict=True):
                if role == 0:
                    head = own
                elif enough(len(np.intersect1d(head, own, assume_unique=True)), len(head), len(own)):
                    links.append((a, b))
            yield pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)
    return test


def _sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The point of a text in 2^16 groups, as the sorted groups of its shingles."""
    for batch in batches:
        yield pd.DataFrame({"node": batch["node"], "sketch": [
            np.sort((s >> _U(48)).astype("<u2")).tobytes() for s in shingle_sets(batch["text"].tolist())]})


def _numbered(column) -> Iterator[np.ndarray]:
    """Groups of sketches with the number of the shingle in its group: what two of them
    have in common is the sum of the smaller counts."""
    for data in column:
        group = np.frombuffer(data, "<u2").astype(np.int64)
        start = np.append(True, group[1:] != group[:-1]) if len(group) else np.zeros(0, bool)
        at = np.arange(len(group))
        yield group << 32 | (at - np.maximum.accumulate(np.where(start, at, 0)))


def _linked(shared: int, n_a: int, n_b: int) -> bool:
    return OF * shared >= SHARED * (n_a + n_b - shared)


def verified(pairs: DataFrame, nodes: DataFrame, table: DataFrame, stored, name: str) -> DataFrame:
    """Links (a, b) among the pairs. The bound is taken again in 2^16 groups, on sketches
    much smaller than the texts; what is left is decided on the whole shingle sets.
    nodes: (node, row); table: (row, text)."""
    sketches = stored(_texts_of(pairs, nodes, table).mapInPandas(_sketches, "node long, sketch binary"), f"{name}-sketches")
    near = stored(_against_heads(pairs, sketches, "sketch", _tested(_numbered, _linked)), f"{name}-near")
    exact = _tested(lambda texts: shingle_sets(texts.tolist()), _linked)
    return stored(_against_heads(near, _texts_of(near, nodes, table), "text", exact), name)


def joined(docs: DataFrame, folder: str) -> DataFrame:
    """docs(doc_id, text, ...) with n_shingles and component_id: the smallest doc_id that
    links reach, the own one included.

    Null and empty texts have no shingle, link with nothing and keep their own doc_id.
    Rows with equal texts are linked, also where they repeat a doc_id. Rows without doc_id
    link like any other; a component of such rows only has a null id. Existing columns
    named n_shingles, component_id or j are replaced. Without rows there is no result
    row. Intermediate tables go below `folder`."""
    spark = docs.sparkSession
    docs = docs.drop("n_shingles", "component_id", "j")

    def stored(frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    table = stored(profile(docs, frequent_shingles(docs)), "table")
    own = table.select("j.row", "j.node", "j.n", "doc_id").where("n > 0")
    first = own.groupBy("node").agg(F.min("row").alias("row"), F.min("doc_id").alias("name"))
    nodes = stored(table.select("j.row", "j.n", "j.counts").join(_sent(stored(first, "first")), "row"), "nodes")
    points = nodes.select(F.col("node").alias("id"), "n", "counts")
    texts = table.select("j.row", "text")
    cells = table.select("j.row", "j.n", "j.node", "j.keys").join(_sent(nodes.select("row")), "row").select(
        F.explode("keys").alias("key"), F.col("node").alias("id"), "n")
    shared = stored(cells.repartition("key").sortWithinPartitions("key", "id").mapInPandas(
        _shared_keys, "key long, id long, n int, head long, head_n int"), "shared")

    # first round: every member of a cell against its head
    fits = (OF * F.least("n", "head_n") >= SHARED * F.greatest("n", "head_n")) & (F.col("id") != F.col("head"))
    tried = stored(bounded(shared.where(fits).select(F.col("head").alias("a"), F.col("id").alias("b")).distinct(), points),
                   "tried")
    links = verified(tried, nodes.select("node", "row"), texts, stored, "links")
    part = stored(components(links, "join-parts"), "parts")

    # second round: cells with members that are not connected yet
    member = shared.join(part.toDF("id", "part"), "id", "left").select(
        "key", "head", "id", "n", F.coalesce("part", "id").alias("part"))
    open_cells = member.groupBy("key").agg(F.min("part").alias("least"), F.max("part").alias("most"), F.count("*").alias("size"))
    # with two members the pair has been tried
    open_cells = open_cells.where("least <> most and size > 2").select("key", "size")
    by_size = Window.partitionBy("key").orderBy("n", "id")
    # a member whose neighbours in size are too unlike in size has no partner in the cell
    near = (SHARED * F.col("n") <= OF * F.lag("n").over(by_size)) | (SHARED * F.lead("n").over(by_size) <= OF * F.col("n"))
    sized = member.join(open_cells, "key").withColumn("near", F.coalesce(near, F.lit(False))).where("near")
    dealt = sized.withColumn("block", F.floor((F.row_number().over(by_size) - 1) / CELL_BLOCK))
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / CELL_BLOCK))
    dealt = dealt.select("key", "head", "id", "n", "part", "block", F.explode(blocks).alias("other")).groupBy(
        "head", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id", "n",
        "part").agg(F.collect_list("key").alias("keys"))
    found = dealt.join(points.select("id", "counts"), "id").repartition("head", "low", "high").sortWithinPartitions(
        "head", "low", "high").select("head", "low", "high", "block", "id", "n", "part", "keys", "counts").mapInPandas(
        _cell_pairs, "a long, b long").distinct()
    known = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    further = stored(found.join(known, ["a", "b"], "left_anti"), "further")
    more = verified(further, nodes.select("node", "row"), texts, stored, "more")
    ends = more.join(part.toDF("a", "pa"), "a", "left").join(part.toDF("b", "pb"), "b", "left").select(
        F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b"))
    whole = components(ends, "join-whole")

    named = nodes.select("node", "name").join(part.toDF("node", "part"), "node", "left").withColumn(
        "part", F.coalesce("part", "node")).join(whole.toDF("part", "whole"), "part", "left").withColumn(
        "whole", F.coalesce("whole", "part"))
    least = named.groupBy("whole").agg(F.min("name").alias("component_id"))
    named = named.join(least, "whole").select("node", "component_id")
    return table.withColumn("node", F.when(F.col("j.n") > 0, F.col("j.node"))).join(named, "node", "left").select(
        *docs.columns, F.col("j.n").cast("long").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
