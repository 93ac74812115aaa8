"""Mixing to target weights by soft domain membership.

A classifier learned from the labelled table predicts how likely a document belongs to
each domain. The document rates r >= 0 solve

    least squares over domains k of (sum over d of r_d * tokens_d * p_dk - target_k)

and of these rates the ones nearest to 1. A document's rate is what is left of 1 + sum
over k of shift_k * p_dk after the projection to what may be emitted, so K shifts are all
that is stored or sent. They are found by projected gradient steps, each scaled by the
K x K matrix of the documents that move and shortened until it helps. A step needs one
small aggregate over the table of memberships. Steps end when the totals are met, or when
no step helps any more: then they cannot be met, which is reported.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from clientele.llm import textscan
from clientele.llm.bpe import byte_pairs
from clientele.llm.labelled import sample_by_class
from clientele.llm.quality import fit, prior_shift

SYMBOLS = 64
TRAIN_ROWS = 1500              # labelled rows of each domain that training reads at most
TOLERANCE = 1e-4               # largest relative miss of a domain's total
NEAR = 1e-7                    # weight of the rates' distance from 1 beside the squares
STALLED = 1e-10                # least gain of a step, per token
KEEP_FROM = 0.5                # a document with this rate is kept once at least
BATCH = 1 << 20


def _symbol(byte: int) -> int:
    """Separators, both cases of letters, digits, three kinds of signs, bytes of others."""
    char = chr(byte)
    if byte < 128:
        return (byte - 96 if char.islower() else byte - 38 if char.isupper() else 53 if char.isdigit() else
                0 if byte <= 32 else 54 if char == "|" else 55 if char == "!" else 56)
    return 57 + (byte & 3) if byte < 0xC0 else 61 if byte < 0xE0 else 62 if byte < 0xF0 else 63


_SYMBOLS = np.array([_symbol(b) for b in range(256)], np.int32)


def _trigrams(texts) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of symbols and where each text begins; a text has its bytes + 1 of them."""
    raw = textscan.utf8(texts)
    line = np.concatenate([[0, 0], _SYMBOLS[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]])
    first = np.concatenate([[0], np.cumsum(np.fromiter((len(t) + 1 for t in raw), np.int64, len(raw)))])
    return (line[:-2] * SYMBOLS + line[1:-1]) * SYMBOLS + line[2:], first


@dataclass
class Domains:
    names: list[str]
    table: np.ndarray          # trigram x domain
    bias: np.ndarray

    def posterior(self, texts) -> np.ndarray:
        out = []
        for a, b in textscan.batches([len(t) if isinstance(t, str) else 0 for t in texts], BATCH):
            found, first = _trigrams(texts[a:b])
            z = np.add.reduceat(self.table[found], first[:-1], axis=0) / np.diff(first)[:, None] + self.bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out.append(z / z.sum(axis=1, keepdims=True))
        return np.concatenate(out) if out else np.zeros((0, len(self.names)))


def learn_domains(docs: DataFrame, labels: DataFrame, names: list[str], rows: int = TRAIN_ROWS) -> Domains:
    """From docs(doc_id, text) with labels(doc_id, label in names): softmax over mean
    trigram vectors. Reads at most `rows` labelled rows of each domain, chosen by a hash
    of doc_id. A domain without rows gets a posterior near 0."""
    counts = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect() if r["label"] in names}

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bags = [np.unique(_trigrams([t])[0], return_counts=True) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"],
                                "ids": [i.astype(np.int32).tobytes() for i, _ in bags],
                                "shares": [(n / n.sum()).astype(np.float32).tobytes() for _, n in bags]})

    chosen = F.broadcast(sample_by_class(labels, names, rows))         # at most rows x domains ids
    bagged = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "label", "text").mapInPandas(
        digest, "doc_id long, label string, ids binary, shares binary")
    table, bias, seen = fit(bagged, names, SYMBOLS ** 3)
    return Domains(names, table, bias + prior_shift(seen, names, counts))


def memberships(docs: DataFrame, domains: Domains, tokenizer: str) -> DataFrame:
    """docs and the columns n_tokens and p (array of domain probabilities). A null text is
    an empty one, with 0 tokens."""
    sent = docs.sparkSession.sparkContext.broadcast(domains)

    @F.pandas_udf("n_tokens long, p array<double>")
    def member(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pairs = byte_pairs(tokenizer)
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch]
            yield pd.DataFrame({"n_tokens": [len(i) for i in pairs.encode(texts)], "p": list(sent.value.posterior(texts))})
    return docs.withColumn("member", member("text")).select(*docs.columns, "member.n_tokens", "member.p")


@dataclass
class Fit:
    """Rates that were found, and how near they come to the totals."""
    names: list[str]
    shift: np.ndarray
    want: np.ndarray
    reached: np.ndarray
    keep_from: float | None

    @property
    def miss(self) -> dict[str, float]:
        """By how much the total of each domain is off, as a share of what is wanted (of a
        domain that is not wanted, as a share of all tokens wanted)."""
        unit = np.where(self.want > 0, self.want, max(self.want.sum(), 1.0))
        return dict(zip(self.names, ((self.reached - self.want) / unit).tolist(), strict=True))

    @property
    def rate(self) -> Column:
        return _emitted(_shifted(self.shift), self.keep_from)


def _shifted(shift: np.ndarray) -> Column:
    return sum((F.get("p", F.lit(k)) * float(v) for k, v in enumerate(shift)), F.lit(1.0))


def _emitted(x: Column, keep_from: float | None) -> Column:
    """Copies expected of a row: never less than 0, and 1 at least from `keep_from` on."""
    rate = F.greatest(x, F.lit(0.0))
    return rate if keep_from is None else F.when(x >= keep_from, F.greatest(x, F.lit(1.0))).otherwise(rate)


def _area(x: Column, keep_from: float | None) -> Column:
    """The integral of _emitted from 0 to x; convex."""
    below = F.greatest(x, F.lit(0.0)) * F.greatest(x, F.lit(0.0)) / 2
    if keep_from is None:
        return below
    first = keep_from ** 2 / 2
    return F.when(x < keep_from, below).when(x < 1, first + (x - keep_from)).otherwise(first + (1 - keep_from) + (x * x - 1) / 2)


def _slope(x: Column, keep_from: float | None) -> Column:
    """How fast _emitted grows; its jump at `keep_from` is spread over half a copy."""
    if keep_from is None:
        return F.when(x > 0, 1.0).otherwise(0.0)
    return (_emitted(x + 0.25, keep_from) - _emitted(x - 0.25, keep_from)) / 0.5


def solve(members: DataFrame, names: list[str], weights: dict[str, float], total: float | None = None,
          shrinking: tuple[str, ...] = (), keep_from: float | None = None) -> Fit:
    """Rates of the rows of members(n_tokens, p).

    `weights`: the share of each domain, made to sum to 1; a domain left out gets 0.
    `total`: tokens wanted; by default the least total at which no domain outside
    `shrinking` has to lose tokens. `keep_from`: no rate is from here to 1, such rows are
    kept once. Domains without tokens cannot be met and are left out of the squares.
    Without tokens every rate is 1. Totals that cannot be met are met as nearly as the
    squares say, with a warning."""
    size = len(names)
    p = [F.get("p", F.lit(k)) for k in range(size)]
    share = np.array([max(0.0, weights.get(n, 0.0)) for n in names])
    share = share / share.sum()
    pairs = [(k, m) for k in range(size) for m in range(k, size)]

    def look(shift: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        x, n = F.col("x"), F.col("n_tokens")
        row = members.withColumn("x", _shifted(shift)).withColumns(
            {"x_emitted": n * _emitted(x, keep_from), "x_slope": n * _slope(x, keep_from)}).agg(
            *[F.sum(F.col("x_emitted") * q) for q in p], *[F.sum(F.col("x_slope") * p[k] * p[m]) for k, m in pairs],
            F.sum(n * _area(x, keep_from))).first()
        found = np.array([v or 0.0 for v in row], np.float64)
        matrix = np.zeros((size, size))
        for (k, m), v in zip(pairs, found[size:-1], strict=True):
            matrix[k, m] = matrix[m, k] = v
        return found[:size], matrix, float(found[-1])

    shift = np.zeros(size)
    reached, matrix, area = look(shift)
    held, tokens = reached, reached.sum()
    if tokens <= 0:
        return Fit(names, shift, np.zeros(size), held, keep_from)
    bound = [held[k] / share[k] for k, n in enumerate(names) if share[k] > 0 and n not in shrinking]
    want = share * (total if total is not None else max(bound, default=tokens))
    has = held > 0
    scale = np.maximum(held, 1e-9 * tokens)
    near = NEAR * scale ** 2 / tokens          # squares in units of what each domain holds

    def value(at: np.ndarray, area: float) -> float:
        return area - want[has] @ at[has] + (near * at * at)[has].sum() / 2

    while np.abs((reached - want) / np.maximum(want, scale))[has].max() >= TOLERANCE:
        slope = (reached - want + near * shift)[has]
        ridge = near[has] + 1e-12 * np.trace(matrix) / size
        step = np.zeros(size)
        step[has] = -np.linalg.solve(matrix[np.ix_(has, has)] + np.diag(ridge), slope)
        gain, now, part = -(slope @ step[has]), value(shift, area), 1.0
        while part * gain > STALLED * tokens:
            tried = look(shift + part * step)
            if value(shift + part * step, tried[2]) <= now - 1e-4 * part * gain:
                break
            part /= 2
        else:
            break                               # no step helps
        shift = shift + part * step
        reached, matrix, area = tried
    found = Fit(names, shift, want, reached, keep_from)
    off = {n: round(m, 5) for n, m in found.miss.items() if abs(m) > 10 * TOLERANCE}
    if off:
        warnings.warn(f"mixing: totals that cannot be met, off by shares of {off}", stacklevel=2)
    return found


def fit_rates(members: DataFrame, names: list[str], weights: dict[str, float], total: float | None = None,
              shrinking: tuple[str, ...] = (), keep_from: float | None = None) -> Column:
    """The rate of a row of members(n_tokens, p), as a column over them; see `solve`."""
    return solve(members, names, weights, total, shrinking, keep_from).rate


def copies(rate: Column, keep_from: float = KEEP_FROM) -> Column:
    """Whole copies of a row: the rate, its fraction decided by a hash of doc_id. A row
    with a rate of at least `keep_from` is kept once at least; rates fitted with the same
    `keep_from` are the copies expected."""
    chance = F.pmod(F.xxhash64(F.lit(10), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    return F.greatest(F.floor(rate + chance), F.when(rate >= keep_from, 1).otherwise(0)).cast("int")


def mixed(docs: DataFrame, domains: Domains, weights: dict[str, float], tokenizer: str, folder: str,
          total: float | None = None, shrinking: tuple[str, ...] = ()) -> DataFrame:
    """docs(doc_id, text, ...) and n_tokens, p, rate and copies of each row; `folder`: for
    the table of memberships, so that texts are read once. Clashing column names of docs
    are replaced. Repeated rows are rated alike."""
    docs = docs.drop("n_tokens", "p", "rate", "copies", "member")
    memberships(docs, domains, tokenizer).write.parquet(folder)
    members = docs.sparkSession.read.parquet(folder)
    rate = fit_rates(members, domains.names, weights, total, shrinking, KEEP_FROM)
    return members.withColumn("rate", rate).withColumn("copies", copies(F.col("rate")))
