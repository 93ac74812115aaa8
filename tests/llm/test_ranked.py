"""FP-tree search against a plain BM25 in whole numbers."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from clientele.llm import ranked
from clientele.session import scratch_dir
from tests.llm.data import CLASHES, DOCS, empty_documents, odd_documents, prose


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=10):
    counts = [(i, Counter(words(t))) for i, t in docs]
    n_docs, length = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c in counts:
            if c:
                m = 25 + 75 * sum(c.values()) * n_docs // length
                score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m))
                            for t, times in Counter(words(text)).items() if t in c)
                if score > 0:
                    scores.append((-score, math.inf if doc is None else doc))
        out += [(item, r + 1, None if d == math.inf else d, -s) for r, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def found(spark, docs, items):
    docs = docs if not isinstance(docs, list) else spark.createDataFrame([(i, t, None, None, None) for i, t in docs], DOCS)
    items = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("clash") for c in CLASHES})
    rows = ranked.search(docs, items, scratch_dir(spark, "ranked-test")).collect()
    return sorted((tuple(r) for r in rows), key=repr)


def texts(seed, n):
    """Documents of a small vocabulary with copies: a third are the same."""
    rng = random.Random(seed)
    vocabulary = [prose(i, 1) for i in range(120)]
    shared = " ".join(rng.choices(vocabulary, k=30))
    return [(i, shared if i % 3 == 0 else " ".join(vocabulary[int(len(vocabulary) * rng.random() ** 2)] for _ in range(rng.choice([0, 1, 5, 40, 200]))))
            for i in range(n)], [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 12])))) for i in range(25)] + [(90, shared)]


@pytest.mark.parametrize("leaf,tree,rounds", [(16, 8192, 1024), (2, 64, 7)])
def test_ten_best(spark, monkeypatch, leaf, tree, rounds):
    monkeypatch.setattr(ranked, "LEAF", leaf)
    monkeypatch.setattr(ranked, "TREE_DOCS", tree)
    monkeypatch.setattr(ranked, "ITEMS", rounds)
    docs, items = texts(leaf, 500)
    assert found(spark, docs, items) == plain(docs, items)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    items = [(1, "one TWO"), (1, "word word"), (None, "é中文"), (2, None), (3, ""), (4, prose(3, 40)), (4, prose(3, 40)), (5, "zzzzzzzz")]
    assert found(spark, docs, items) == plain([(r["doc_id"], r["text"]) for r in docs.collect()], items)
    assert found(spark, empty_documents(spark), items) == [] and found(spark, docs, []) == []


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = prose(8, 5000) + " É1é;x"
    monkeypatch.setattr(ranked, "PIECE", 100)
    n, counts = ranked.term_counts(text)
    assert n == len(words(text)) and {t.decode(): c for t, c in counts.items()} == Counter(words(text))


def test_branches_are_cut():
    """Bounds hold for every node, and most documents are never scored."""
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 12, 4000)
    terms = np.concatenate([np.sort(rng.choice(300, s, replace=False, p=None)) for s in sizes])
    tfs, ends = rng.integers(1, 4, len(terms)), np.concatenate([[0], np.cumsum(sizes)])
    tree = ranked.Tree(np.arange(4000), 25 + sizes * 4, ends, terms, tfs, 300)
    asked = Counter({b"%d" % t: 1 for t in terms[ends[5]:ends[6]].tolist()})
    # falling frequencies, so terms keep their numbers
    items = ranked.Items([7], [asked], {b"%d" % t: t for t in range(300)}, {t: 2000 - 6 * t for t in range(300)}, 4000)
    bounds, best = tree.bounds(items), ranked.Best(10)
    scores = tree.gain[:, items.terms[0]].astype(np.int64) @ items.weights[0]
    assert all(bounds[i, 0] >= scores[a:b].max() for i, (a, b) in enumerate(zip(tree.lo, tree.hi, strict=True)))
    ranked.descend(tree, items, bounds, 0, best)
    order = np.lexsort((tree.ids, -scores))[:10]
    assert best.ids.tolist() == tree.ids[order].tolist() and best.scores.tolist() == scores[order].tolist()
    assert best.scored < 3000
