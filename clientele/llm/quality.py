"""Quality classifier with supervised subword embeddings.

A word contributes its own hashed vector, those of its character n-grams (with < and >
at its ends) and that of the word pair it ends; a word that repeats the one before it
is marked by a pair vector of its own. A document is the mean of these vectors; softmax
over its product with the output matrix gives the classes. Learned by stochastic
gradient descent in numpy.

At scoring time the output matrix is applied to every hashed vector once, so that a
document needs one look-up per distinct word of its batch instead of one per vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from clientele.llm import textscan
from clientele.llm.labelled import clean_labels, held_out, sample_by_class

BUCKETS = 1 << 17
DIMENSIONS = 8
NGRAMS = (2, 3, 4)
TRAIN_ROWS = 2500            # labelled rows of each class that training reads at most
EPOCHS = 5
RATE = 0.6
BATCH = 1 << 18              # characters scored together; a worker keeps what its largest batch took
_U = np.uint64


@dataclass
class Model:
    classes: list
    table: np.ndarray         # bucket x class: hashed vector times output matrix
    bias: np.ndarray

    def posterior(self, texts) -> np.ndarray:
        """Class probabilities of texts (null: empty), one row each."""
        sizes = [len(t) if isinstance(t, str) else 0 for t in texts]
        parts = [self._logits(textscan.utf8(texts[a:b])) for a, b in textscan.batches(sizes, BATCH)]
        z = np.concatenate(parts) if parts else np.zeros((0, len(self.classes)))
        z = np.exp(z - z.max(axis=1, keepdims=True)) if len(z) else z
        return z / z.sum(axis=1, keepdims=True)

    def _logits(self, texts: list[bytes]) -> np.ndarray:
        first, inverse, pairs, piece, owner = _pieces(texts)
        size = np.bincount(owner, minlength=int(inverse.max(initial=-1)) + 1)
        docs, counts = textscan.owner(first), np.diff(first)
        total = np.bincount(docs, size[inverse] + 1, len(counts)) if len(docs) else np.zeros(len(counts))
        out = np.tile(self.bias.astype(np.float64), (len(counts), 1))
        for k in range(len(self.classes)):
            word = np.bincount(owner, self.table[piece, k], len(size))
            value = word[inverse] + self.table[pairs, k]
            sums = np.bincount(docs, value, len(counts)) if len(docs) else np.zeros(len(counts))
            out[:, k] += sums / np.maximum(total, 1)
        return out


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h % _U(BUCKETS)).astype(np.int64)


def _pieces(texts: list[bytes]):
    """(first, inverse, pairs, piece, owner): word i of the batch is distinct word
    inverse[i] and ends the pair with bucket pairs[i]; piece[j] is the bucket of a word
    or n-gram vector of distinct word owner[j]; see textscan.scan_words for `first`."""
    data, starts, ends, first = textscan.scan_words(texts)
    hashes = textscan.span_hashes(data, starts, ends)
    distinct, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    opening = np.zeros(len(hashes), bool)
    opening[first[:-1][np.diff(first) > 0]] = True
    before = np.where(opening, _U(0), np.roll(hashes, 1)) if len(hashes) else hashes
    pairs = _bucket(textscan.mix(before * _U(0x9E3779B97F4A7C15) + hashes))
    pairs[before == hashes] = 0                     # the mark of a repeated word
    raw = data.tobytes()
    words = b"".join(b"<" + raw[a:b] + b">" for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True))
    points = np.frombuffer(words.decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(_U)
    # lengths in characters: bytes that do not continue one
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    length = begins[ends[at]] - begins[starts[at]] + 2
    stop = np.cumsum(length)
    number = np.repeat(np.arange(len(at)), length)
    piece, owner = [_bucket(distinct)], [np.arange(len(at))]
    for n in NGRAMS:
        if len(points) < n:
            continue
        h = np.zeros(len(points) - n + 1, _U)
        for k in range(n):
            h = h * _U(0x100000001B3) + points[k:k + len(h)] + _U(1)
        inside = np.flatnonzero(np.arange(len(h)) + n <= stop[number[:len(h)]])
        piece.append(_bucket(textscan.mix(h[inside] + _U(n))))
        owner.append(number[inside])
    return first, inverse, pairs, np.concatenate(piece), np.concatenate(owner)


def bags(texts) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct buckets and their shares of the mean vector."""
    out = []
    for text in textscan.utf8(texts):
        _, inverse, pairs, piece, owner = _pieces([text])
        times = np.bincount(inverse, minlength=int(owner.max(initial=-1)) + 1)
        total = np.bincount(piece, times[owner]) if len(piece) else np.zeros(0)
        total = np.bincount(np.concatenate([piece, pairs]), np.concatenate([times[owner], np.ones(len(pairs))])) \
            if len(piece) else total
        ids = np.flatnonzero(total)
        out.append((ids.astype(np.int32), (total[ids] / max(total.sum(), 1)).astype(np.float32)))
    return out


def descend(examples: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, n_classes: int, epochs: int = EPOCHS,
            rate: float = RATE, seed: int = 1, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed vectors and output matrix, learned one example at a time."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (buckets, DIMENSIONS)).astype(np.float32)
    output = np.zeros((DIMENSIONS + 1, n_classes), np.float32)       # the last row is the bias
    steps, step = epochs * len(examples), 0
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            ids, share = examples[i]
            pace = rate * (1 - step / steps)
            mean = np.append(share @ vectors[ids], np.float32(1))
            z = mean @ output
            p = np.exp(z - z.max())
            error = p / p.sum()
            error[target[i]] -= 1
            back = output[:-1] @ error
            output -= np.float32(pace) * np.outer(mean, error)
            vectors[ids] -= np.float32(pace * 10) * np.outer(share, back)
            step += 1
    return vectors, output


def train(docs: DataFrame, labels: DataFrame, classes: list, rows: int = TRAIN_ROWS) -> Model:
    """Fit on docs(doc_id, text) with labels(doc_id, label in `classes`).

    Reads at most `rows` labelled rows of each class, chosen by a hash of doc_id; the
    classes' shares among all labels then set the bias. Null texts are empty texts. A
    class without rows gets probability 0 in practice; without any row all classes are
    equally likely."""
    counts = {r["label"]: r["count"] for r in labels.where(F.col("label").isin(classes)).groupBy("label").count().collect()}
    chosen = sample_by_class(labels, classes, rows)       # at most rows x classes ids

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = bags(batch["text"].tolist())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"],
                                "ids": [i.tobytes() for i, _ in found], "shares": [s.tobytes() for _, s in found]})

    kind = dict(labels.dtypes)["label"]
    bagged = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text").mapInPandas(
        digest, f"doc_id long, label {kind}, ids binary, shares binary")
    table, bias, seen = fit(bagged, classes, BUCKETS)
    return Model(classes, table, bias + prior_shift(seen, classes, counts))


def fit(bagged: DataFrame, classes: list, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(table, bias, rows of each class) from bagged(doc_id, label, ids, shares), a bounded
    sample. Learned in one task, so that only the table comes to the driver."""
    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(batches) or [pd.DataFrame(columns=["doc_id", "label", "ids", "shares"])])
        frame = frame.sort_values(["doc_id", "label"], kind="stable")
        examples = [(np.frombuffer(i, np.int32), np.frombuffer(s, np.float32))
                    for i, s in zip(frame["ids"], frame["shares"], strict=True)]
        target = np.array([classes.index(c) for c in frame["label"]], np.int64)
        vectors, output = descend(examples, target, len(classes), buckets=buckets)
        seen = np.bincount(target, minlength=len(classes))
        yield pd.DataFrame({"table": [(vectors @ output[:-1]).astype(np.float32).tobytes()],
                            "bias": [output[-1].astype(np.float64).tobytes()], "seen": [seen.astype(np.int64).tobytes()]})

    row = bagged.repartition(1).mapInPandas(learn, "table binary, bias binary, seen binary").first()
    return (np.frombuffer(row["table"], np.float32).reshape(buckets, len(classes)),
            np.frombuffer(row["bias"], np.float64), np.frombuffer(row["seen"], np.int64))


def prior_shift(seen: np.ndarray, classes: list, counts: dict) -> np.ndarray:
    """What the bias needs because training saw the classes in other shares than the
    labels have; nothing if there was no row."""
    if not seen.sum():
        return np.zeros(len(classes))
    want = np.array([counts.get(c, 0) for c in classes])
    return np.where(seen > 0, np.log(np.maximum(want, 1) / want.sum()) - np.log(np.maximum(seen, 1) / seen.sum()), -20.0)


def score(model: Model, label, text: str = "text") -> Column:
    """Probability that a text has this label; other columns stay in the JVM."""
    k = model.classes.index(label)

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model.posterior(batch.tolist())[:, k])
    return probability(F.col(text))


def quality_model(docs: DataFrame, labels: DataFrame) -> Model:
    """From labels.quality of the rows that are not held out."""
    return train(docs, clean_labels(labels, "quality").where(~held_out(3, 1)), [0, 1])


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; a null text is an empty one,
    a null doc_id stays null and repeated rows are scored alike."""
    return docs.select("doc_id", held_out(3, 1).alias("held_out"), score(model, 1).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))
