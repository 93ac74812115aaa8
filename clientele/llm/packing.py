"""Packing of documents into sequences by a grouping genetic algorithm.

A document longer than a sequence is cut into full pieces, so only what is left over
has to be packed. Pieces are dealt into blocks of bounded size; every block is evolved
by several islands, whose elites move to the next island between epochs.

A solution gives each piece a bin. Crossover injects well-filled bins of one parent as
a whole into the other, removes the bins that hold a piece twice and places the pieces
that lost their bin by best fit.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from clientele.llm.bpe import byte_pairs

SEQUENCE = 2048
END_ID = 0
BLOCK_PIECES = 8192       # pieces evolved together
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 2, 2, 3, 4
PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"
STATE = "block long, island int, rows binary, lengths binary, population array<binary>"


def cut(docs: DataFrame, tokenizer: str, size: int = SEQUENCE) -> DataFrame:
    """Pieces of docs(doc_id, text): ids of the text, then END_ID. Null text is empty.

    `row` is unique per piece even where documents repeat; it depends on how the rows
    are spread, so write the result before it is used twice."""
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, row = byte_pairs(tokenizer), TaskContext.get().partitionId() << 40
        for batch in batches:
            out = []
            for doc_id, ids in zip(batch["doc_id"], pairs.encode([t if isinstance(t, str) else "" for t in batch["text"]]),
                                   strict=True):
                raw, total = np.append(ids, END_ID).astype("<u4").tobytes(), len(ids) + 1
                start, stop = 0, total % size or size
                for piece in range(-(-total // size)):
                    out.append((row, doc_id, piece, start, stop - start, zlib.crc32(raw[4 * start:4 * stop])))
                    row, start, stop = row + 1, stop, stop + size
            frame = pd.DataFrame(out, columns=["row", "doc_id", "piece", "start", "length", "ids_crc32"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(encode, PIECES)


def _best_fit(lengths: list[int], order: list[int], bins: np.ndarray, room: dict[int, int], size: int) -> None:
    """Put the pieces of `order` into the fullest bins they fit, else into new ones."""
    fresh = max(room, default=-1) + 1
    open_bins = sorted((free << 32) | b for b, free in room.items() if free)
    for item in order:
        need = lengths[item]
        at = bisect_left(open_bins, need << 32)
        if at < len(open_bins):
            entry = open_bins.pop(at)
            free, b = (entry >> 32) - need, entry & 0xFFFFFFFF
        else:
            free, b = size - need, fresh
            fresh += 1
        bins[item] = b
        if free:
            insort(open_bins, (free << 32) | b)


def _first(lengths: np.ndarray, order: np.ndarray, size: int) -> np.ndarray:
    bins = np.zeros(len(lengths), np.int64)
    _best_fit(lengths.tolist(), order.tolist(), bins, {}, size)
    return bins


def _worth(bins: np.ndarray, lengths: np.ndarray, size: int) -> tuple[int, float]:
    """Fewer bins first; then the mean squared fill, which favours uneven fills."""
    _, at = np.unique(bins, return_inverse=True)
    fill = np.bincount(at, lengths)
    return len(fill), -float(np.mean((fill / size) ** 2))


def _cross(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """A child of `a` that receives some of the well-filled bins of `b`."""
    fill = np.bincount(b, lengths)
    good = np.flatnonzero(fill >= 0.99 * size)
    chosen = np.zeros(len(fill), bool)
    chosen[good[rng.random(len(good)) < rng.uniform(0.2, 0.8)]] = True
    injected = chosen[b]
    child, broken = a.copy(), np.zeros(int(a.max()) + 1, bool)
    broken[a[injected]] = True
    # a few of the worst bins are opened too, so that their pieces can move
    own = np.bincount(a, lengths)
    worst = np.argsort(np.where(own > 0, own, size))[:1 + int(rng.integers(0, 4))]
    broken[worst] = True
    loose = broken[a] & ~injected
    child[injected] = b[injected] + len(broken)
    kept = ~loose
    names, at = np.unique(child[kept], return_inverse=True)
    child[kept] = at
    room = dict(enumerate((size - np.bincount(at, lengths[kept], len(names))).astype(int).tolist()))
    items = np.flatnonzero(loose)
    # longest first, with some noise to differ from child to child
    items = items[np.argsort(-lengths[items] * rng.uniform(0.9, 1.0, len(items)), kind="stable")]
    _best_fit(lengths.tolist(), items.tolist(), child, room, size)
    return child


def _evolve(population: list[np.ndarray], lengths: np.ndarray, size: int, seed: int,
            generations: int, keep: int) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    ranked = sorted(((_worth(p, lengths, size), i, p) for i, p in enumerate(population)), key=lambda x: x[:2])[:keep]
    least, count = -(-int(lengths.sum()) // size), keep
    for _ in range(generations):
        if ranked[0][0][0] <= least:
            break                     # no packing has fewer bins
        for k in range(keep):
            mother, father = (ranked[int(i)][2] for i in rng.integers(0, len(ranked), 2))
            child = _cross(mother, father, lengths, size, rng)
            ranked.append((_worth(child, lengths, size), count, child))
            count += 1
        ranked = sorted(ranked, key=lambda x: x[:2])[:keep]
    return [p for _, _, p in ranked]


def pack(pieces: DataFrame, n_pieces: int, size: int = SEQUENCE, block_pieces: int = BLOCK_PIECES,
         islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS,
         population: int = POPULATION) -> DataFrame:
    """Places pieces(row, length): returns (row, sequence_id, place).

    `row` is unique and not null, 0 < length <= size. `n_pieces`: how many there are
    (a count, for the number of blocks). No piece gives no row. Full pieces are
    sequences of their own. Blocks are dealt by a hash of `row`, so they are even
    whatever document or source the pieces come from. All random numbers derive from
    block, island and epoch: a lost task gives the same again."""
    full = pieces.where(F.col("length") == size).select(
        "row", (F.lit(-1) - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("place"))
    blocks = max(1, -(-n_pieces // block_pieces))
    parts = pieces.where(F.col("length") < size).select("row", "length", F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"))
    gathered = parts.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("row", "length"))).alias("items")).select(
        "block", F.col("items.row").alias("rows"), F.col("items.length").alias("lengths"),
        F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
    # an island is a row, dealt like any other; one block is never larger than its bound allows
    gathered = gathered.repartition(min(blocks * islands, 20_000), "block", "island")

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, island, rows, lengths in zip(batch["block"], batch["island"], batch["rows"], batch["lengths"], strict=True):
                lengths = np.asarray(lengths, np.int64)
                rng = np.random.default_rng([int(block), int(island), 0])
                first = [_first(lengths, np.argsort(-lengths * rng.uniform(1 - spread, 1.0, len(lengths)), kind="stable"), size)
                         for spread in (0.0 if island == 0 else 0.02, *(0.05 * k for k in range(1, population)))]
                yield grown(block, island, np.asarray(rows, np.int64), lengths, first, 1)

    def grown(block, island, rows, lengths, members, epoch) -> pd.DataFrame:
        seed = (int(block) * 1000 + int(island)) * 1000 + epoch
        best = _evolve(members, lengths, size, seed, generations, population)
        return pd.DataFrame({"block": [block], "island": np.array([island], np.int32), "rows": [rows.tobytes()],
                             "lengths": [lengths.astype(np.int32).tobytes()],
                             "population": [[p.astype(np.int32).tobytes() for p in best]]})

    def go_on(epoch: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for block, island, rows, lengths, members, elite in batch.itertuples(index=False, name=None):
                    solutions = [np.frombuffer(p, np.int32).astype(np.int64) for p in (elite, *members)]
                    yield grown(block, island, np.frombuffer(rows, np.int64), np.frombuffer(lengths, np.int32).astype(np.int64),
                                solutions, epoch)
        return run

    state = gathered.select("block", "island", "rows", "lengths").mapInPandas(begin, STATE)
    ring = Window.partitionBy("block").orderBy("island")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for epoch in range(2, epochs + 1):
        elite = F.get("population", F.lit(0))
        state = state.withColumn("elite", F.coalesce(F.lag(elite).over(ring), F.last(elite).over(whole))).select(
            "block", "island", "rows", "lengths", "population", "elite").mapInPandas(go_on(epoch), STATE)

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, rows, lengths, islands_ in zip(batch["block"], batch["rows"], batch["lengths"], batch["best"], strict=True):
                lengths = np.frombuffer(lengths, np.int32).astype(np.int64)
                bins = min((np.frombuffer(b, np.int32) for b in islands_), key=lambda b: _worth(b, lengths, size))
                order = np.argsort(bins, kind="stable")
                ends = np.cumsum(lengths[order])
                first = np.flatnonzero(np.diff(bins[order], prepend=-1))
                base = np.repeat(ends[first] - lengths[order][first], np.diff(np.append(first, len(order))))
                yield pd.DataFrame({"row": np.frombuffer(rows, np.int64)[order],
                                    "sequence_id": (int(block) << 32) + bins[order].astype(np.int64),
                                    "place": ends - lengths[order] - base})

    best = state.groupBy("block").agg(F.first("rows").alias("rows"), F.first("lengths").alias("lengths"),
                                      F.collect_list(F.get("population", F.lit(0))).alias("best"))
    return best.mapInPandas(finish, "row long, sequence_id long, place long").unionByName(full)


def packed_documents(docs: DataFrame, tokenizer: str, folder: str, size: int = SEQUENCE) -> DataFrame:
    """docs(doc_id, text) as (doc_id, piece, start, length, ids_crc32, sequence_id,
    offset), one row per piece. Repeated rows are packed as often as they come; a null
    doc_id stays null; other columns are left out. `folder`: for the table of pieces,
    so that texts are encoded once."""
    cut(docs, tokenizer, size).write.parquet(folder)
    pieces = docs.sparkSession.read.parquet(folder)
    places = pack(pieces.select("row", "length"), pieces.count(), size)
    return pieces.join(places, "row").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id",
                                             F.col("place").alias("offset"))
