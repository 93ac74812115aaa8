"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated models of order 4 over letters, of toxic and of ordinary documents.
Their upper levels have counts of their own; the lower ones are the continuation counts
of both classes together, so an expression that neither class knows well gets nearly
the same probability from both, and only what one class really says moves the score.
Letters let inflected and newly built words share their stems; a second pair of models,
over words, knows expressions whose letters are common. Letters are code points, words are
known by 64-bit hashes; the table of ratios is computed in Spark from the counts and grows
with them. Workers read the most frequent SENT_ROWS rows of it from the shared folder; what a
text has of the others is joined to it. Both give the same scores. The driver sees no row of it.

The log-likelihood ratios are normalised by length: letters as the mean of the whole document
and of its most toxic passage, words as what the different ones say beyond an unknown word,
over the square root of their number, as chance alone would let the sum grow. A logistic curve makes a probability of these. Counts cover all
labelled rows that may be learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType

from clientele.llm import files, textscan
from clientele.llm.labelled import clean_labels, held_out, sample_by_class, with_labels
from clientele.session import scratch_dir

ORDER = 4
POINT = 21                             # bits of a code point
LETTERS, CONTEXT, SHORT, SHORT_CONTEXT, WORD = range(5)    # kinds of rows of the table of ratios
DISCOUNT = 0.75
SENT_ROWS = 2_000_000                  # most rows of the table of ratios in a worker (12 bytes each)
WORD_DISCOUNT = 2.0                    # documents with a word that say nothing about a class
TELLING = 1.0                          # by how much a word must exceed an unknown one to count
PASSAGE = 9                            # letters of the passage that counts
CALIBRATION_ROWS = 1500                # rows of each class that fit the logistic curve
FOLDS = 3                              # a row is rated for the curve by counts without its fold
BATCH = 1 << 17                        # characters scored together; a worker keeps what its largest batch took


# ASCII other than letters and digits separates words; all digits are one letter.
_ASCII = np.array([ord(chr(b).lower()) if chr(b).isalpha() else 48 if chr(b).isdigit() else 0 for b in range(128)], np.int64)
_CLEAN = np.array([b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)], np.uint8).tobytes()
_LAST_TWO = (1 << 2 * POINT) - 1


def _lower(texts) -> list[str]:
    return [t.lower() if isinstance(t, str) else "" for t in texts]


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, last, first): the three code points before each place of lower-case texts
    in one number, and the one at the place. Separators in a row count as one, and one
    opens each text; places first[d] to first[d + 1] belong to text d."""
    points = np.frombuffer((" ".join(texts) + " ").encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    points = np.where(points < 128, _ASCII[np.minimum(points, 127)], points)
    borders = np.concatenate([[0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))])
    keep = points != 0
    keep[1:] |= points[:-1] != 0
    first = np.concatenate([[0], np.cumsum(keep)])[borders]
    line = np.concatenate([np.zeros(ORDER - 1, np.int64), points[keep]])
    context = line[:-3] << 2 * POINT | line[1:-2] << POINT | line[2:-1]
    # no context reaches back into the text before
    for k in range(ORDER - 2):
        at = first[1:-1] + k
        at = at[at < first[-1]]
        context[at] &= (1 << POINT * (k + 1)) - 1
    return context, line[3:], first


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first): the words of lower-case texts; see `letters`."""
    hashes, first = textscan.word_hashes([t.translate(_CLEAN) for t in textscan.utf8(texts)])
    return hashes.view(np.int64), first


def table_key(kind, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The 64-bit key of rows of the table of ratios."""
    kind = np.atleast_1d(np.asarray(kind, np.int64)).astype(np.uint64) + np.uint64(1)
    a, b = np.asarray(a, np.int64).view(np.uint64), np.asarray(b, np.int64).view(np.uint64)
    return textscan.mix(textscan.mix(a + kind * np.uint64(0x9E3779B97F4A7C15)) + b).view(np.int64)


def _ranges(texts, limit: int):
    return textscan.batches([len(t) if isinstance(t, str) else 0 for t in texts], limit)


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, at): the number of each key among the different ones, and where each stands first."""
    codes, found = pd.factorize(key)
    at = np.empty(len(found), np.int64)
    at[codes[::-1]] = np.arange(len(key))[::-1]
    return codes, at


def count_grams(docs: DataFrame) -> DataFrame:
    """(kind, a, b) and a column c<fold>_<label> for each fold and label: how often
    docs(text, label, fold) have a letter b after a context a (LETTERS), and in how many
    of them a word a comes (WORD). Summed per batch before the shuffle."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = _lower(batch["text"])
            group = (batch["fold"] * 2 + batch["label"]).to_numpy(np.int64)
            for start, end in _ranges(texts, 2 * BATCH):
                a, b, first = letters(texts[start:end])
                said, first_word = words(texts[start:end])
                once = pd.DataFrame({"text": textscan.owner(first_word), "word": said}).drop_duplicates()
                for kind, a, b, text in ((LETTERS, a, b, textscan.owner(first)),
                                         (WORD, once["word"].to_numpy(), np.zeros(len(once), np.int64), once["text"].to_numpy())):
                    codes, at = _distinct(table_key(kind, a, b))
                    owner = group[start:end][text]
                    for g in np.unique(owner):
                        n = np.bincount(codes[owner == g], minlength=len(at))
                        has = np.flatnonzero(n)
                        n = n[has]
                        yield pd.DataFrame({"kind": kind, "a": a[at[has]], "b": b[at[has]], "fold": int(g) // 2,
                                            "n0": n * (1 - g % 2), "n1": n * (g % 2)})

    return docs.select("text", "label", "fold").mapInPandas(
        count, "kind int, a long, b long, fold int, n0 long, n1 long").groupBy("kind", "a", "b").agg(*[
            F.sum(F.when(F.col("fold") == f, F.col(f"n{side}")).otherwise(0)).alias(f"c{f}_{side}")
            for f in range(FOLDS) for side in (0, 1)])


SKIPS = [*range(FOLDS), None]          # the models: each without one fold, and the whole one


def _of(side: int, skip: int | None) -> Column:
    """The count of a class without a fold."""
    return sum((F.col(f"c{f}_{side}") for f in range(FOLDS) if f != skip), F.lit(0))


def _each(make) -> list[Column]:
    return [make(j, side) for j in range(len(SKIPS)) for side in (0, 1)]


def _discounted(count: Column, total: Column, lower: Column, back: Column) -> Column:
    """Probability of one level: discounted counts, the rest shared out as `lower`."""
    return back * lower + F.greatest(count - DISCOUNT, F.lit(0.0)) / F.greatest(total, F.lit(1.0))


def _ratio(p: str) -> list[Column]:
    return [(F.log(F.col(f"{p}{j}_1")) - F.log(F.col(f"{p}{j}_0"))).cast("float").alias(f"r{j}") for j in range(len(SKIPS))]


def _contexts(rows: DataFrame, keys: list[str], count, total: str, back: str) -> DataFrame:
    """Sums of counts of each context, and what its discounts leave to the lower level."""
    sums = rows.groupBy(*keys).agg(
        *_each(lambda j, s: F.sum(count(j, s)).cast("double").alias(f"{total}{j}_{s}")),
        *_each(lambda j, s: F.sum(F.least(count(j, s).cast("double"), F.lit(DISCOUNT))).alias(f"given{j}_{s}")), F.sum("n").alias("n"))
    return sums.select(*keys, "n", *_each(lambda j, s: F.col(f"{total}{j}_{s}")), *_each(lambda j, s: F.when(
        F.col(f"{total}{j}_{s}") > 0, F.col(f"given{j}_{s}") / F.col(f"{total}{j}_{s}")).otherwise(1.0).alias(f"{back}{j}_{s}")))


def letter_ratios(counted: DataFrame, folder: str) -> DataFrame:
    """(kind, a, b, n, r<model>): log-likelihood ratios of what count_grams found; n: how
    often it comes. A letter after a context that is not in the table has the ratio of its
    CONTEXT (0 if that is not there) and of SHORT, without the first letter, or where that
    is not there, of SHORT_CONTEXT (or 0): what both classes share cancels out. `folder`: for
    the tables of the levels, each of which several others read."""
    def written(frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(f"{folder}/{name}")
        return frame.sparkSession.read.parquet(f"{folder}/{name}")

    grams_ = counted.where(F.col("kind") == LETTERS).withColumn("a2", F.col("a").bitwiseAND(F.lit(_LAST_TWO))).withColumn(
        "n", _of(0, None) + _of(1, None)).drop("kind")
    long = written(_contexts(grams_, ["a2", "a"], lambda j, s: _of(s, SKIPS[j]), "t", "k"), "long")
    short = written(grams_.groupBy("a2", "b").agg(F.sum("n").alias("n"), *_each(
        lambda j, s: F.count(F.when(_of(s, SKIPS[j]) > 0, 1)).alias(f"m{j}_{s}"))), "short")
    short_long = written(_contexts(short, ["a2"], lambda j, s: F.col(f"m{j}_{s}"), "u", "l"), "short_long")
    # the lowest levels know both classes together
    last = F.col("a2").bitwiseAND(F.lit((1 << POINT) - 1)).alias("a1")
    two = written(short.select(last, "b").groupBy("a1", "b").agg(F.count(F.lit(1)).alias("m")), "two")
    before = two.groupBy("a1").agg(F.sum("m").alias("all"), F.sum(F.least(F.col("m").cast("double"), F.lit(DISCOUNT))).alias("less"))
    one = two.groupBy("b").agg(F.count(F.lit(1)).alias("k"))
    row = one.agg(F.count(F.lit(1)), F.coalesce(F.sum("k"), F.lit(0))).first()
    letter = (F.col("k") + 0.5) / F.lit(max(0.5 * row[0] + row[1], 0.5))
    two = two.join(before, "a1").join(one, "b").select("a1", "b", _discounted(
        F.col("m"), F.col("all").cast("double"), letter, F.col("less") / F.col("all")).alias("shared"))
    middle = written(short.join(short_long.drop("n"), "a2").withColumn("a1", last).join(two, ["a1", "b"]).select("a2", "b", "n", *_each(
        lambda j, s: _discounted(F.col(f"m{j}_{s}"), F.col(f"u{j}_{s}"), F.col("shared"), F.col(f"l{j}_{s}")).alias(f"p{j}_{s}"))),
        "middle")
    whole = grams_.join(long.drop("n"), ["a2", "a"]).join(middle.drop("n"), ["a2", "b"]).select("a", "b", "n", *_each(
        lambda j, s: _discounted(_of(s, SKIPS[j]), F.col(f"t{j}_{s}"), F.col(f"p{j}_{s}"), F.col(f"k{j}_{s}")).alias(f"q{j}_{s}")))

    def rows(frame: DataFrame, kind: int, a: str, b: Column, p: str) -> DataFrame:
        return frame.select(F.lit(kind).alias("kind"), F.col(a).alias("a"), b.cast("long").alias("b"), "n", *_ratio(p))
    return rows(whole, LETTERS, "a", F.col("b"), "q").unionByName(rows(long, CONTEXT, "a", F.lit(0), "k")).unionByName(
        rows(middle, SHORT, "a2", F.col("b"), "p")).unionByName(rows(short_long, SHORT_CONTEXT, "a2", F.lit(0), "l"))


def word_ratios(counted: DataFrame) -> tuple[DataFrame, list[float]]:
    """(kind, a, b, n, r<model>) of words, from the documents of both classes that have
    them: discounted, the rest shared out by the documents of both together; and for each
    model the ratio of a word that is not in the table, because it is within the discount
    in both classes. All sums are over all words."""
    said = counted.where(F.col("kind") == WORD)
    sums = said.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(c), F.lit(0)).cast("double") for c in _each(lambda j, s: _of(s, SKIPS[j]))],
                    *[F.coalesce(F.sum(c), F.lit(0.0)) for c in _each(
                        lambda j, s: F.least(_of(s, SKIPS[j]).cast("double"), F.lit(WORD_DISCOUNT)))]).first()
    size, total, given = sums[0], np.array(sums[1:1 + 2 * len(SKIPS)]).reshape(-1, 2), np.array(sums[1 + 2 * len(SKIPS):]).reshape(-1, 2)
    back = np.where(total > 0, given / np.maximum(total, 1), 1.0)

    def p(j: int, s: int) -> Column:
        shared = (_of(0, SKIPS[j]) + _of(1, SKIPS[j]) + 0.5) / float(max(0.5 * size + total[j].sum(), 0.5))
        seen = F.greatest(_of(s, SKIPS[j]) - WORD_DISCOUNT, F.lit(0.0)) / float(max(total[j, s], 1))
        return (shared * float(back[j, s]) + seen).alias(f"p{j}_{s}")
    telling = said.where(F.greatest(_of(0, None), _of(1, None)) > WORD_DISCOUNT)
    table = telling.select("a", (_of(0, None) + _of(1, None)).alias("n"), *_each(p)).select(
        F.lit(WORD).alias("kind"), "a", F.lit(0).cast("long").alias("b"), "n", *_ratio("p"))
    return table, [float(x) for x in np.log(back[:, 1]) - np.log(back[:, 0])]


@F.pandas_udf(LongType())
def _key(kind: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(table_key(kind.to_numpy(), a.to_numpy(), b.to_numpy()))


def _found(key: np.ndarray, keys: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Ratios of keys in a sorted table, NaN for those that are not there."""
    if not len(keys):
        return np.full(len(key), np.nan)
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    return np.where(keys[at] == key, ratio[at], np.nan).astype(np.float64)


@dataclass
class Sent:
    """The most frequent rows of the table of ratios, sorted by key."""
    keys: np.ndarray
    ratio: np.ndarray


_read: dict[tuple, Sent] = {}          # of this worker: the rows it read last


def _sent(folder: str, column: str) -> Sent:
    """One model's column of a table in the shared folder, read once per worker."""
    if (folder, column) not in _read:
        _read.clear()                  # not two tables at a time
        tables = []
        for name, _ in files.sizes(folder, ".parquet"):
            with files.open_file(folder, name) as stream:
                tables.append(pq.read_table(stream, columns=["key", column]))
        rows = pa.concat_tables(tables).sort_by("key") if tables else None
        _read[folder, column] = Sent(np.zeros(0, np.int64), np.zeros(0, np.float32)) if rows is None else Sent(
            rows["key"].to_numpy(), rows[column].to_numpy())
        del tables, rows
        pa.default_memory_pool().release_unused()
    return _read[folder, column]


@dataclass
class Model:
    folder: str                        # of the most frequent rows of the table of ratios
    column: str                        # the column of this model there
    unknown: float                     # ratio of a word that is not in the table
    weights: np.ndarray                # of the logistic curve: passage, words, document, constant
    rest: DataFrame | None = None      # (key, ratio) of the other rows, if there are any
    own: Sent | None = None            # used in place of the folder

    def __getstate__(self):
        return {**self.__dict__, "rest": None}

    @property
    def keys(self) -> np.ndarray:
        return (self.own or _sent(self.folder, self.column)).keys

    @property
    def ratio(self) -> np.ndarray:
        return (self.own or _sent(self.folder, self.column)).ratio

    def joined_with(self, key: np.ndarray, ratio: np.ndarray) -> Model:
        """The model that also knows these rows of the rest."""
        if not len(key):
            return self
        key, at = np.unique(key, return_index=True)
        to = np.searchsorted(self.keys, key)
        return Model(self.folder, self.column, self.unknown, self.weights,
                     own=Sent(np.insert(self.keys, to, key), np.insert(self.ratio, to, ratio[at])))

    def probes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, key): what texts in lower case need of the rest of the table, once each."""
        a, b, first = letters(texts)
        said, first_word = words(texts)
        short, none = a & _LAST_TWO, np.zeros(len(a), np.int64)
        text = textscan.owner(first)
        out = pd.DataFrame({"text": np.concatenate([text] * 4 + [textscan.owner(first_word)]), "key": np.concatenate([
            table_key(LETTERS, a, b), table_key(CONTEXT, a, none), table_key(SHORT, short, b), table_key(SHORT_CONTEXT, short, none),
            table_key(WORD, said, np.zeros(len(said), np.int64))])}).drop_duplicates()
        key = out["key"].to_numpy()
        missing = np.isnan(_found(key, self.keys, self.ratio))
        return out["text"].to_numpy()[missing], key[missing]

    def ratios(self, texts) -> np.ndarray:
        """(passage, words, document): highest mean ratio of PASSAGE letters in a row, the
        sum of what different words say beyond an unknown one and TELLING over the root of
        their number, and the mean of the letters over the whole text."""
        texts = _lower(texts)
        parts = [self._ratios(texts[a:b]) for a, b in _ranges(texts, BATCH)]
        return np.concatenate(parts) if parts else np.zeros((0, 3))

    def _letter_ratios(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = table_key(LETTERS, a, b)
        codes, at = _distinct(key)
        out = _found(key[at], self.keys, self.ratio)
        new = np.flatnonzero(np.isnan(out))
        a, b = a[at[new]], b[at[new]]
        none = np.zeros(len(a), np.int64)
        seen, short, context = (_found(k, self.keys, self.ratio) for k in (
            table_key(CONTEXT, a, none), table_key(SHORT, a & _LAST_TWO, b), table_key(SHORT_CONTEXT, a & _LAST_TWO, none)))
        out[new] = np.nan_to_num(seen) + np.where(np.isnan(short), np.nan_to_num(context), short)
        return out[codes]

    def _ratios(self, texts: list[str]) -> np.ndarray:
        a, b, first = letters(texts)
        size = np.diff(first)
        sums = np.concatenate([[0.0], np.cumsum(self._letter_ratios(a, b))])
        out = np.zeros((len(texts), 3))
        has = np.flatnonzero(size)
        if not len(has):
            return out
        out[has, 2] = (sums[first[has + 1]] - sums[first[has]]) / size[has]
        # passages that begin at each place; near the end of a text they are cut short
        stop = np.minimum(np.arange(len(a)) + PASSAGE, np.repeat(first[1:], size))
        out[has, 0] = np.maximum.reduceat((sums[stop] - sums[:-1]) / PASSAGE, first[has])
        said, first = words(texts)
        key = table_key(WORD, said, np.zeros(len(said), np.int64))
        codes, at = _distinct(key)
        once = np.unique(textscan.owner(first) * np.int64(max(len(at), 1)) + codes)
        text, word = once // max(len(at), 1), once % max(len(at), 1)
        beyond = np.maximum(np.nan_to_num(_found(key[at], self.keys, self.ratio) - self.unknown - TELLING), 0)
        out[:, 1] = np.bincount(text, beyond[word], len(texts)) / np.sqrt(1 + np.bincount(text, minlength=len(texts)))
        return out

    def probability(self, texts) -> np.ndarray:
        z = self.ratios(texts) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def with_rest(docs: DataFrame, model: Model) -> DataFrame:
    """docs(text, ...) and the columns rest_keys, rest_ratios: the rows of the rest of the
    table that a text needs, found by joins. Equal texts share them. Rows that workers
    read by themselves are not looked for."""
    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = _lower(batch["text"])
            for start, end in _ranges(texts, BATCH):
                text, key = model.probes(texts[start:end])
                yield pd.DataFrame({"text_a": batch["text_a"].to_numpy()[start:end][text],
                                    "text_b": batch["text_b"].to_numpy()[start:end][text], "key": key})

    docs = docs.withColumns({"text_a": F.xxhash64("text"), "text_b": F.xxhash64(F.lit(1), "text")})
    needed = docs.select("text_a", "text_b", "text").mapInPandas(look, "text_a long, text_b long, key long").distinct()
    found = needed.join(model.rest, "key").groupBy("text_a", "text_b").agg(F.collect_list(F.struct("key", "ratio")).alias("rest"))
    return docs.join(found, ["text_a", "text_b"], "left").withColumns(
        {"rest_keys": F.col("rest.key"), "rest_ratios": F.col("rest.ratio")}).drop("text_a", "text_b", "rest")


def _rest_of(keys, ratios) -> tuple[np.ndarray, np.ndarray]:
    """The rows that with_rest found for the texts of a batch."""
    has = [i for i, k in enumerate(keys) if k is not None]
    empty = np.zeros(0)
    return (np.concatenate([empty.astype(np.int64), *[np.asarray(keys[i], np.int64) for i in has]]),
            np.concatenate([empty.astype(np.float32), *[np.asarray(ratios[i], np.float32) for i in has]]))


def calibrate(ratios: np.ndarray, labels: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Logistic curve over the ratios, by Newton steps with a small ridge. `shares`: how
    common the classes are among all labels; rows are weighted to them."""
    x = np.column_stack([ratios, np.ones(len(ratios))])
    width, seen = x.shape[1], np.bincount(labels, minlength=2)
    if len(ratios) == 0 or seen.min() == 0:
        return np.append(np.zeros(width - 1), 6.0 if seen[1] else -6.0)
    weight = (shares / shares.sum() / np.maximum(seen, 1))[labels] * len(labels)
    w, ridge = np.zeros(width), 1e-2 * np.append(np.ones(width - 1), 0)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-6),
                               x.T @ (weight * (p - labels)) + ridge * w)
        w -= step * min(1.0, 3.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-7:
            break
    return w


def toxicity_model(docs: DataFrame, labels: DataFrame) -> Model:
    """From labels.toxic of all rows that are not held out.

    All of them are counted. At most CALIBRATION_ROWS of each class, chosen by a hash of
    doc_id, fit the logistic curve, each rated by a model without its fold of the counts.
    Without labels, or with one class only, the score is the same for all."""
    fold = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(FOLDS)).cast("int")
    labels = clean_labels(labels, "toxic").where(~held_out(4, 2) & F.col("label").isin(0, 1)).withColumn("fold", fold)
    docs = docs.select("doc_id", "text")
    spark, folder = docs.sparkSession, scratch_dir(docs.sparkSession, "toxicity")
    count_grams(with_labels(docs, labels)).write.parquet(f"{folder}/counts")
    counted = spark.read.parquet(f"{folder}/counts")
    table, unknown = word_ratios(counted)
    names = [f"r{j}" for j in range(len(SKIPS))]
    letter_ratios(counted, f"{folder}/levels").unionByName(table).where(       # a context with ratios of 0 is as one that is not there
        ~F.col("kind").isin(CONTEXT, SHORT_CONTEXT) | (F.greatest(*[F.abs(r) for r in names]) > 0)).select(
        _key("kind", "a", "b").alias("key"), "n", *names).write.parquet(f"{folder}/ratios")
    ratios = spark.read.parquet(f"{folder}/ratios")
    rest, most = None, f"{folder}/ratios"
    if ratios.count() > SENT_ROWS:
        most = f"{folder}/sent"
        ratios.orderBy(F.desc("n"), "key").limit(SENT_ROWS).write.parquet(most)
        ratios.join(spark.read.parquet(most).select("key"), "key", "left_anti").write.parquet(f"{folder}/rest")
        rest = spark.read.parquet(f"{folder}/rest")

    def model(j: int, weights: np.ndarray) -> Model:
        return Model(most, names[j], unknown[j], weights,
                     None if rest is None else rest.select("key", F.col(names[j]).alias("ratio")))

    chosen = F.broadcast(sample_by_class(labels, [0, 1], CALIBRATION_ROWS))          # bounded
    sample = docs.join(chosen, "doc_id").select("doc_id", "label", "fold", "text")
    frames = []
    for f in range(FOLDS):
        own = model(f, np.zeros(4))

        def rate(batches: Iterator[pd.DataFrame], own=own) -> Iterator[pd.DataFrame]:
            for batch in batches:
                used = own.joined_with(*_rest_of(batch["rest_keys"], batch["rest_ratios"]))
                found = used.ratios(batch["text"].tolist())
                yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "a": found[:, 0], "b": found[:, 1],
                                    "c": found[:, 2]})

        rated = sample.where(F.col("fold") == f)
        if own.rest is None:
            rated = rated.withColumns({"rest_keys": F.lit(None).cast("array<long>"), "rest_ratios": F.lit(None).cast("array<float>")})
        else:
            rated = with_rest(rated, own)
        frames.append(rated.mapInPandas(rate, "doc_id long, label int, a double, b double, c double").toPandas())
    frame = pd.concat(frames).sort_values(["doc_id", "a", "b", "c"])
    shares = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    weights = calibrate(frame[["a", "b", "c"]].to_numpy(np.float64), frame["label"].to_numpy(np.int64),
                        np.array([shares.get(0, 0), shares.get(1, 0)], np.float64))
    return model(FOLDS, weights)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs(text, ...) and score, the probability that the text is toxic. Clashing column
    names of docs are replaced."""
    docs = docs.drop("score")
    if model.rest is None:
        @F.pandas_udf("double")
        def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield pd.Series(model.probability(batch.tolist()))
        return docs.withColumn("score", probability("text"))

    @F.pandas_udf("double")
    def joined_probability(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, keys, ratios in batches:
            yield pd.Series(model.joined_with(*_rest_of(keys, ratios)).probability(text.tolist()))
    docs = with_rest(docs.drop("rest", "rest_keys", "rest_ratios", "text_a", "text_b"), model)
    return docs.withColumn("score", joined_probability("text", "rest_keys", "rest_ratios")).drop("rest_keys", "rest_ratios")


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; a null text is an empty one, a
    null doc_id stays null and repeated rows are scored alike."""
    rows = scored(docs.select("doc_id", "text", held_out(4, 2).alias("held_out")), model)
    return rows.select("doc_id", "held_out", "score").withColumn(
        "predicted", (F.col("score") >= 0.3).cast("int"))
