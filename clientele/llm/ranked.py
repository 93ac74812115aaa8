"""Ranked lexical search over document FP-trees, by branch and bound.

Documents are reduced to the terms that some item holds. A task orders the terms of each
document by falling document frequency and enters its documents, block by block, into a
trie: documents with the same frequent terms share a path. A node keeps, for its subtree,
the highest tf of each term, the smallest m and the smallest doc_id. Since a document's
score grows with tf and falls with m, these bound every score below the node; an item goes
depth first, best child first, and leaves out nodes that cannot reach its ten best so far.
The ten best are kept from block to block and meet in Spark.

Scores are those of a BM25 in whole numbers: see `search`.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SEPARATOR = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
PIECE = 1 << 20              # bytes of a text counted at once
ITEMS = 1024                 # items asked at once; more go in further rounds
TREE_DOCS = 8192             # documents of a tree at most
TREE_CELLS = 1 << 24         # documents x terms of a tree at most
LEAF = 16                    # documents that are no longer parted
VECTORS = "doc_id long, n long, terms array<int>, tfs array<long>"
FOUND = "item long, item_id long, doc_id long, score long"
NO_ID = np.iinfo(np.int64).max      # stands for a null doc_id, which comes last


def term_counts(text: str | None) -> tuple[int, Counter]:
    """All terms of the text with their number, only A-Z lower-cased. A long text is
    counted in pieces that end at a separator."""
    data = (text or "").encode("utf-8", "replace").lower()     # of bytes: A-Z only
    counts, n, at = Counter(), 0, 0
    while at < len(data):
        end = len(data)
        if end - at > PIECE:
            cut = SEPARATOR.search(data, at + PIECE)
            end = cut.end() if cut else end
        found = TERM.findall(data, at, end)
        n += len(found)
        counts.update(found)
        at = end
    return n, counts


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """docs(doc_id, text) as (doc_id, n, terms, tfs): n counts all terms of a text, the
    arrays hold those of the vocabulary."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            sizes, ends, terms, tfs = [], [0], [], []
            for text in batch["text"]:
                n, counts = term_counts(text.as_py())
                held = sorted((known[t], c) for t, c in counts.items() if t in known)
                terms += [t for t, _ in held]
                tfs += [c for _, c in held]
                sizes.append(n)
                ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())),
                 pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))], ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, VECTORS)


class Items:
    """The items of a round: for each the numbers of its terms and count times weight."""

    def __init__(self, ids: list, counted: list[Counter], vocabulary: dict[bytes, int], df: dict[int, int], documents: int):
        # terms are renumbered by falling document frequency, the order of the trie's paths
        order = sorted((-df[t], t) for t in vocabulary.values() if t in df)
        self.rank = np.full(len(vocabulary), -1, np.int64)
        self.rank[[t for _, t in order]] = np.arange(len(order))
        self.n_terms, self.ids = len(order), ids
        self.terms, self.weights = [], []
        for counts in counted:
            held = sorted((int(self.rank[vocabulary[t]]), c * math.floor(1000 * math.log((2 * documents + 2) / (2 * df[vocabulary[t]] + 1))))
                          for t, c in counts.items() if vocabulary[t] in df)
            self.terms.append(np.array([r for r, _ in held], np.int64))
            self.weights.append(np.array([w for _, w in held], np.int64))
        # products of the matrix are exact in doubles unless an item has very many terms
        kind = np.float64 if all(w.sum() < 2 ** 32 for w in self.weights) else np.int64
        self.matrix = np.zeros((self.n_terms, len(ids)), kind)
        for j, (t, w) in enumerate(zip(self.terms, self.weights, strict=True)):
            self.matrix[t, j] = w


def gains(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term of weight one adds to the score; at most a million."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Tree:
    """An FP-tree in arrays. Documents lie in the order of their paths, a node is a range
    of them; ranges of at most LEAF documents are leaves and not parted further."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, ends: np.ndarray, terms: np.ndarray, tfs: np.ndarray, n_terms: int):
        starts = ends[:-1]
        # within a document by frequency, then the documents by their paths
        owner = np.repeat(np.arange(len(ids)), np.diff(ends))
        at = np.lexsort((terms, owner))
        terms, tfs = terms[at], tfs[at]
        path = terms.astype(">u4")
        order = sorted(range(len(ids)), key=lambda d: (path[starts[d]:ends[d + 1]].tobytes(), m[d], ids[d]))
        self.ids, self.m = ids[order], m[order]
        self.tf = np.zeros((len(ids), n_terms), np.int64)
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.tf[place[owner], terms] = tfs
        self.gain = gains(self.tf, self.m[:, None]).astype(np.int32)
        first, sizes = starts[order], np.diff(ends)[order]
        self.lo, self.hi, self.children = [0], [len(ids)], [[]]
        waiting = [(0, 0)]
        while waiting:
            node, depth = waiting.pop()
            lo, hi = self.lo[node], self.hi[node]
            # documents that end here come first; in a longer path all share the terms above
            done = lo + int(np.searchsorted(sizes[lo:hi] > depth, True))
            step = terms[first[done:hi] + depth]
            borders = [*range(lo, done, LEAF), *(done + np.flatnonzero(np.diff(step, prepend=-1))).tolist(), hi]
            parts = list(zip(borders[:-1], borders[1:], strict=True))
            if len(parts) == 1 and parts[0][0] >= done:
                waiting.append((node, depth + 1))               # one way on: no node of its own
                continue
            begin = None
            for a, b in [*parts, (hi, hi + LEAF + 1)]:
                if begin is not None and b - begin > LEAF:       # neighbours that are small share a leaf
                    self._node(node, begin, a)
                    begin = None
                if b - a > LEAF:
                    if a < hi:
                        waiting.append((self._node(node, a, b), depth + 1))
                elif begin is None:
                    begin = a
        self._summaries()

    def _node(self, parent: int, lo: int, hi: int) -> int:
        self.children[parent].append(len(self.lo))
        self.lo.append(lo)
        self.hi.append(hi)
        self.children.append([])
        return len(self.lo) - 1

    def _summaries(self) -> None:
        """Highest tf, smallest m and smallest doc_id of every subtree, from the leaves up."""
        count = len(self.lo)
        self.top = np.zeros((count, self.tf.shape[1]), np.int64)
        self.least, self.first = np.zeros(count, np.int64), np.zeros(count, np.int64)
        for node in range(count - 1, -1, -1):
            below = self.children[node]
            if below:
                self.top[node], self.least[node], self.first[node] = self.top[below].max(0), self.least[below].min(), self.first[below].min()
            else:
                lo, hi = self.lo[node], self.hi[node]
                self.top[node], self.least[node], self.first[node] = self.tf[lo:hi].max(0), self.m[lo:hi].min(), self.ids[lo:hi].min()

    def bounds(self, items: Items) -> np.ndarray:
        """Nodes x items: no document below the node scores higher."""
        out = np.empty((len(self.lo), len(items.ids)), np.int64)
        for a in range(0, len(out), 512):
            out[a:a + 512] = gains(self.top[a:a + 512], self.least[a:a + 512, None]).astype(items.matrix.dtype) @ items.matrix
        return out


class Best:
    """The best documents of an item so far, in order."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.scored = k, np.empty(0, np.int64), np.empty(0, np.int64), 0

    def may_enter(self, bound: int, first: int) -> bool:
        if bound <= 0 or len(self.ids) < self.k:
            return bound > 0
        return bound > self.scores[-1] or (bound == self.scores[-1] and first < self.ids[-1])

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        self.scored += len(ids)
        held = scores > 0
        scores, ids = np.concatenate([self.scores, scores[held]]), np.concatenate([self.ids, ids[held]])
        keep = np.lexsort((ids, -scores))[:self.k]
        self.scores, self.ids = scores[keep], ids[keep]


def descend(tree: Tree, items: Items, bounds: np.ndarray, j: int, best: Best) -> None:
    """Depth first for item j; a node is looked at again when its turn comes, since the
    ten best may have risen by then."""
    terms, weights, mine = items.terms[j], items.weights[j], bounds[:, j]
    stack = [0]
    while stack:
        node = stack.pop()
        if not best.may_enter(mine[node], tree.first[node]):
            continue
        below = tree.children[node]
        if below:
            # the best child is looked at first, of equals the one with the smallest doc_id
            stack += sorted(below, key=lambda c: (mine[c], -tree.first[c]))
        else:
            lo, hi = tree.lo[node], tree.hi[node]
            best.add(tree.gain[lo:hi][:, terms].astype(np.int64) @ weights, tree.ids[lo:hi])


def _searched(found: DataFrame, items: Items, documents: int, length: int, k: int) -> DataFrame:
    sent = found.sparkSession.sparkContext.broadcast(items)
    per_tree = max(64, min(TREE_DOCS, TREE_CELLS // max(1, items.n_terms)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        best = [Best(k) for _ in items.ids]
        held: list[pa.RecordBatch] = []

        def ask() -> None:
            block = pa.Table.from_batches(held).combine_chunks()
            terms, tfs = block["terms"].combine_chunks(), block["tfs"].combine_chunks()
            ends = np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy(zero_copy_only=False))])
            ranks = items.rank[terms.flatten().to_numpy()]
            ids = block["doc_id"].fill_null(NO_ID).to_numpy()
            n = block["n"].to_numpy()
            # whole numbers of any size: n times the number of documents may pass 64 bits
            m = np.array([25 + 75 * size * documents // length for size in n.tolist()], np.int64)
            tree = Tree(ids, m, ends, ranks, tfs.flatten().to_numpy(), items.n_terms)
            bounds = tree.bounds(items)
            for j in range(len(items.ids)):
                descend(tree, items, bounds, j, best[j])

        rows = 0
        for batch in batches:
            while len(batch):
                part = batch.slice(0, per_tree - rows)
                held.append(part)
                rows, batch = rows + len(part), batch.slice(len(part))
                if rows == per_tree:
                    ask()
                    held, rows = [], 0
        if held:
            ask()
        if not best:
            return
        numbers = np.concatenate([np.full(len(b.ids), j) for j, b in enumerate(best)])
        ids = np.concatenate([b.ids for b in best])
        yield pa.RecordBatch.from_arrays(
            [pa.array(numbers, pa.int64()), pa.array([items.ids[j] for j in numbers], pa.int64()),
             pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(np.concatenate([b.scores for b in best]), pa.int64())],
            ["item", "item_id", "doc_id", "score"])

    return found.where(F.size("terms") > 0).mapInArrow(run, FOUND)


def search(docs: DataFrame, items: DataFrame, folder: str, k: int = 10) -> DataFrame:
    """items(item_id, text) against docs(doc_id, text): (item_id, rank, doc_id, score), the
    k documents with the highest scores above 0, equal ones by doc_id.

    Terms are runs of letters and digits of ASCII and of all signs beyond it; A-Z are
    lower-cased. With N documents that have a term, L their terms, df the documents of a
    term: w = floor(1000 ln((2N + 2) / (2 df + 1))), m = 25 + 75 n N div L for a document of
    n terms, and a term of the item, each time it comes, adds w (10^9 tf div (1000 tf + 8 m)).

    Every row is a document and every item row an item: repeated rows compete, repeated
    item_ids get a list each. A null doc_id comes last among equals. Null and empty texts
    hold no term, so such documents are not found and such items get no row, as with an
    empty table. Other columns are left out. Items are the stated queries: they are sent to
    the documents, ITEMS at a time. `folder`: shared, for the counted documents."""
    spark = docs.sparkSession
    rounds = max(1, -(-items.count() // ITEMS))
    out = None
    for i in range(rounds):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds)) == i).select("item_id", "text").collect()
        counted = [term_counts(r["text"])[1] for r in some]
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*counted)))}
        path = f"{folder}/vectors-{i}"
        vectors(docs, vocabulary).write.parquet(path)
        held = spark.read.parquet(path)
        totals = held.where("n > 0").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("length")).first()
        # at most a row for each term of these items
        df = dict(held.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).toArrow().to_pandas().itertuples(index=False, name=None))
        asked = Items([r["item_id"] for r in some], counted, vocabulary, df, totals["documents"])
        found = _searched(held, asked, totals["documents"], totals["length"] or 1, k)
        found = found.withColumn("item", F.col("item") * rounds + i)
        out = found if out is None else out.unionByName(found)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
