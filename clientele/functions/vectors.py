"""Numpy kernel of the similarity search: the best k of a block, no pair list."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa

METRICS = ("cosine", "l2", "ip")
# Similarities are compared after rounding, so that the last bits of a float
# product decide neither a threshold nor a tie.
DIGITS = 9
CELLS = 1 << 20              # similarities held at once
WAITING, SCORED = 1 << 17, 1 << 14       # pairs that wait to be scored in double precision, and those scored at once


def matrix(column: pa.Array | pa.ChunkedArray, kind: type = np.float64) -> np.ndarray:
    """list<float> column -> (rows, dimensions), by default in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    if not rows:
        return np.empty((0, 0))
    values = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=kind is np.float64)
    if len(values) % rows:
        raise ValueError("the vectors have different lengths")
    return values.reshape(rows, -1)


def narrow(column: pa.ChunkedArray) -> np.ndarray:
    """`matrix` in the precision the column has: floats take half of the memory until they are compared."""
    return matrix(column, np.float32 if column.type.value_type == pa.float32() else np.float64)


def keys(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Id column -> sortable numpy array (integers stay integers, else text)."""
    out = column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()
    return out.astype(str) if out.dtype == object else out


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; a zero row becomes NaN and never matches."""
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(length > 0, vectors / length, np.nan)


def scores(queries: np.ndarray, corpus: np.ndarray, metric: str) -> np.ndarray:
    """Similarity matrix, larger = closer: cosine of unit vectors, inner product or minus L2."""
    return np.round(_scores(queries, corpus, metric), DIGITS)


def _scores(queries: np.ndarray, corpus: np.ndarray, metric: str) -> np.ndarray:
    """The same, not rounded yet."""
    out = queries @ corpus.T
    if metric == "l2":
        out *= -2
        out += (queries ** 2).sum(1)[:, None] + (corpus ** 2).sum(1)[None, :]
        np.sqrt(np.maximum(out, 0, out=out), out=out)
        np.negative(out, out=out)
    return out


def _places(mask: np.ndarray) -> np.ndarray:
    """np.flatnonzero, several times as fast where few are true."""
    flat = mask.ravel()
    if len(flat) < 4096 or 50 * np.count_nonzero(flat) > len(flat):
        return np.flatnonzero(flat)
    whole = len(flat) // 64 * 64
    words = np.packbits(flat[:whole]).view(np.uint64)
    some = np.flatnonzero(words)
    at = np.flatnonzero(np.unpackbits(words[some].view(np.uint8)))
    return np.concatenate([some[at >> 6] * 64 + (at & 63), np.flatnonzero(flat[whole:]) + whole])


class Best:
    """The k best corpus ids per query seen so far. Equal scores go by id.

    Queries meet the corpus in tiles of at most CELLS similarities, whatever the blocks.
    Cosines are taken in single precision first, which is twice as fast: what may be among
    the best within the error of that is scored again in double precision, a pair at a time.
    `floor`, if given, is a similarity per query; rows below it are left out."""

    def __init__(self, qids: np.ndarray, queries: np.ndarray, k: int, metric: str, threshold: float | None,
                 exclude_same_id: bool, tenants: np.ndarray | None = None, tile: int = 1024, floor: np.ndarray | None = None):
        self.qids, self.queries, self.k, self.metric = qids, unit(queries) if metric == "cosine" else queries, k, metric
        self.threshold, self.exclude, self.tenants, self.tile = threshold, exclude_same_id, tenants, tile
        self.score = np.full((len(qids), k), -np.inf)
        self.ids: np.ndarray | None = None
        self.floor = np.full(len(qids), -np.inf) if floor is None else np.where(np.isnan(floor), -np.inf, floor)
        if metric == "cosine":
            # of a product of unit vectors: rounding of both and of every addition, and DIGITS
            self.slack = 1.1 * (self.queries.shape[1] + 8) * 2.0 ** -24 + 10.0 ** -DIGITS
            self.rough, self.bar = self.queries.astype(np.float32), np.empty(len(qids), np.float32)
            self._raise(slice(None))

    def _least(self, part: slice | np.ndarray) -> np.ndarray:
        """What a similarity has to reach; at the threshold itself it is too low yet."""
        least = np.maximum(self.score[part, -1], self.floor[part])
        return least if self.threshold is None else np.maximum(least, self.threshold)

    def _raise(self, part: slice | np.ndarray) -> None:
        self.bar[part] = self._least(part) - self.slack

    def add(self, ids: np.ndarray, corpus: np.ndarray, tenants: np.ndarray | None = None,
            only: np.ndarray | None = None) -> None:
        """`only`: numbers of the queries that meet these rows, by default all."""
        if not len(ids) or not len(self.qids):
            return
        if self.metric == "cosine":
            self.add_parts(ids, corpus, [(0, len(ids), only)], tenants)
            return
        order = np.argsort(ids, kind="stable")      # argmax below then prefers the lower id
        ids, corpus = ids[order], corpus[order]
        tenants = None if tenants is None else tenants[order]
        self._name(ids)
        step = max(1, CELLS // self.tile)
        for low in range(0, len(ids), step):
            some = slice(low, low + step)
            for start in range(0, len(self.qids if only is None else only), self.tile):
                part = slice(start, start + self.tile)
                self._tile(part if only is None else only[part], ids[some], corpus[some], None if tenants is None else tenants[some])

    def _name(self, ids: np.ndarray) -> None:
        """Makes room for ids like these."""
        if self.ids is None:
            self.ids = np.full((len(self.qids), self.k), ids[0], dtype=ids.dtype)
        elif ids.dtype.kind == "U" and ids.dtype.itemsize > self.ids.dtype.itemsize:
            self.ids = self.ids.astype(ids.dtype)

    def add_parts(self, ids: np.ndarray, corpus: np.ndarray, parts: Iterable[tuple[int, int, np.ndarray | None]],
                  tenants: np.ndarray | None = None) -> None:
        """Cosine only. Of every part (low, high, only) the rows from low to high meet the
        queries `only`, or all of them. A part costs little more than its pairs."""
        if not len(ids) or not len(self.qids):
            return
        self._name(ids)
        rough = np.empty(corpus.shape, np.float32)
        for a in range(0, len(corpus), SCORED):
            rough[a:a + SCORED] = unit(corpus[a:a + SCORED].astype(np.float64))
        waiting, found = [], 0
        for low, high, only in parts:
            tile = max(self.tile, min(8 * self.tile, CELLS // 4 // (high - low)))
            for start in range(0, len(self.qids) if only is None else len(only), tile):
                if only is None:
                    part = slice(start, start + tile)
                    asked, bar = self.rough[part], self.bar[part]
                else:
                    part = only[start:start + tile]
                    asked, bar = self.rough.take(part, axis=0), self.bar.take(part)
                step = max(1, CELLS // len(bar))
                for a in range(low, high, step):
                    b = min(a + step, high)
                    sim = asked @ rough[a:b].T
                    hit = _places(sim >= bar[:, None])
                    if not len(hit):
                        continue
                    if len(hit) > 8 * self.k * len(bar):
                        hit = self._promising(sim, part, ids[a:b], None if tenants is None else tenants[a:b])
                    query, row = np.divmod(hit, b - a)
                    waiting.append((query + start if only is None else part[query], row + a, sim.ravel()[hit]))
                    found += len(hit)
                    if found > WAITING or 2 * sim.size > CELLS:      # a large tile is worth a higher bar
                        self._settle(ids, corpus, tenants, waiting)
                        waiting, found, bar = [], 0, self.bar[part]
        self._settle(ids, corpus, tenants, waiting)

    def _promising(self, sim: np.ndarray, part: slice | np.ndarray, ids: np.ndarray, tenants: np.ndarray | None) -> np.ndarray:
        """The pairs of a tile that may be among the k best of its rows."""
        bar = self.bar[part][:, None]
        sim[np.isnan(sim)] = -np.inf
        if self.exclude:
            sim[self.qids[part][:, None] == ids[None, :]] = -np.inf
        if tenants is not None:
            sim[self.tenants[part][:, None] != tenants[None, :]] = -np.inf
        if self.k < len(ids):
            bar = np.maximum(bar, np.partition(sim, -self.k, axis=1)[:, -self.k, None] - np.float32(2 * self.slack))
        return np.flatnonzero((sim >= bar) & (sim > -np.inf))

    def _settle(self, ids: np.ndarray, corpus: np.ndarray, tenants: np.ndarray | None, waiting: list) -> None:
        """Scores pairs (query, row, rough similarity) in double precision and keeps the best."""
        if not waiting:
            return
        query, row, sim = (np.concatenate(side) for side in zip(*waiting, strict=True))
        query, keep = query.astype(np.int64), sim >= self.bar[query]
        if self.exclude:
            keep &= ~(self.qids[query] == ids[row])
        if tenants is not None:
            keep &= self.tenants[query] == tenants[row]
        query, row, sim = query[keep], row[keep], sim[keep]
        if len(query) > SCORED:
            # what is below the k-th of its query by more than both may be off is not scored
            bits = sim.view(np.int32)
            order = np.argsort((query << 32) - (bits ^ ((bits >> 31) & 0x7FFFFFFF)))
            query, row, sim = query[order], row[order], sim[order]
            starts = np.flatnonzero(np.diff(query, prepend=-1))
            sizes = np.diff(starts, append=len(query))
            kth = np.where(sizes >= self.k, sim[np.minimum(starts + self.k - 1, len(sim) - 1)], -np.inf)
            keep = sim >= np.repeat(kth.astype(np.float32) - np.float32(2 * self.slack), sizes)
            query, row = query[keep], row[keep]
        score = np.empty(len(query))
        for start in range(0, len(query), SCORED):
            some = slice(start, start + SCORED)
            score[some] = np.einsum("ij,ij->i", self.queries.take(query[some], axis=0), unit(corpus.take(row[some], axis=0).astype(np.float64)))
        score = np.round(score, DIGITS)
        keep = (score >= self._least(query)) & (score > -np.inf)
        if self.threshold is not None:
            keep &= score > self.threshold
        query, row, score = query[keep], row[keep], score[keep]
        if not len(query):
            return
        # the k so far stand beside the new ones of a query
        part = np.unique(query)
        query = np.concatenate([np.repeat(part, self.k), query])
        score = np.concatenate([self.score[part].ravel(), score])
        named = np.concatenate([self.ids[part].ravel(), ids[row]])
        order = np.lexsort((named, -score, query))
        first = np.searchsorted(query[order], part)
        best = order[first[:, None] + np.arange(self.k)]
        self.score[part], self.ids[part] = score[best], named[best]
        self._raise(part)

    def _tile(self, part: slice | np.ndarray, ids: np.ndarray, corpus: np.ndarray, tenants: np.ndarray | None) -> None:
        sim = _scores(self.queries[part], corpus, self.metric)
        # most queries gain nothing from most tiles; rounding keeps the order, so the largest
        # one tells. A NaN is no less than anything: such rows are looked at.
        top = np.round(sim.max(axis=1), DIGITS)
        look = np.flatnonzero(~(top < self._least(part)))
        if not len(look):
            return
        sim, part = np.round(sim[look], DIGITS), np.arange(len(self.qids))[part][look]
        sim[np.isnan(sim)] = -np.inf
        if self.exclude:
            sim[self.qids[part][:, None] == ids[None, :]] = -np.inf
        if tenants is not None:
            sim[self.tenants[part][:, None] != tenants[None, :]] = -np.inf
        if self.threshold is not None:
            sim[sim <= self.threshold] = -np.inf
        sim[sim < self.floor[part][:, None]] = -np.inf
        # only queries that may gain something are ranked again
        rising = np.flatnonzero((sim.max(axis=1) >= self.score[part, -1]) & (sim.max(axis=1) > -np.inf))
        if not len(rising):
            return
        sim, part = sim[rising], part[rising]
        rows = np.arange(len(sim))
        found, found_ids = [self.score[part]], [self.ids[part]]
        for _ in range(min(self.k, len(ids))):
            best = sim.argmax(axis=1)
            found.append(sim[rows, best][:, None])
            found_ids.append(ids[best][:, None])
            sim[rows, best] = -np.inf
        score, named = np.hstack(found), np.hstack(found_ids)
        keep = np.lexsort((named, -score), axis=-1)[:, :self.k]
        self.score[part] = np.take_along_axis(score, keep, 1)
        self.ids[part] = np.take_along_axis(named, keep, 1)

    def table(self, schema: pa.Schema) -> pa.Table:
        """(qid, id, similarity) of everything found."""
        if self.ids is None:
            return schema.empty_table()
        row, col = np.nonzero(self.score > -np.inf)
        columns = [self.qids[row], self.ids[row, col], self.score[row, col]]
        return pa.table([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)
