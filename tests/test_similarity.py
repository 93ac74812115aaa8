"""Similarity search at sizes and shapes where leaving things out matters."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clientele.operators import buckets, pivots
from clientele.operators.similarity import _arrow, _result_schema, similar, similar_lsh


def table(spark, vectors, key="id", kind="double"):
    rows = [(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"{key} long, embedding array<{kind}>")


def clustered(seed, rows, clusters=40, dimensions=16):
    """Tight clusters; a third of all rows is one vector."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dimensions))
    out = centres[rng.integers(clusters, size=rows)] + 0.05 * rng.normal(size=(rows, dimensions))
    out[::3] = centres[0]
    return out


def plain(asked, stored, k, metric, threshold=None, same=False):
    if metric == "cosine":
        asked, stored = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (asked, stored))
        sim = asked @ stored.T
    else:
        sim = -np.linalg.norm(asked[:, None] - stored[None], axis=2)
    out = set()
    for q, row in enumerate(np.round(sim, 7)):
        order = [i for i in np.lexsort((np.arange(len(row)), -row)) if not (same and i == q) and (threshold is None or row[i] > threshold)]
        out |= {(q, int(i), r + 1) for r, i in enumerate(order[:k])}
    return out


@pytest.mark.parametrize("metric,threshold", [("cosine", None), ("cosine", 0.9), ("l2", None), ("l2", -1.0)])
def test_blocks_are_exact(spark, metric, threshold):
    vectors = clustered(1, 900)
    asked, stored = table(spark, vectors[:200], "qid"), table(spark, vectors)
    found = similar(asked, stored, 3, threshold, metric=metric, exclude_same_id=True, strategy="blocks", block_rows=60).collect()
    mine = {(r.qid, r.id, r["rank"]) for r in found}
    ties = plain(vectors[:200], vectors, 3, metric, threshold, same=True)
    assert mine == ties


def _met(spark, vectors, asked_rows):
    asked, stored = table(spark, vectors[:asked_rows], "qid"), table(spark, vectors)
    schema = _result_schema(asked, stored, "qid", "id")
    met = []
    pivots.search(asked, stored, schema, _arrow(schema), dict(k=3, metric="cosine", threshold=None, exclude_same_id=True), 100, met)
    home, rest, ranges = met
    sizes = dict(zip(ranges.blocks.tolist(), ranges.rows.tolist(), strict=True))
    visits = home.select("block").unionByName(rest.select("block")).groupBy("block").count().collect()
    return sum(sizes[r["block"]] * r["count"] for r in visits) / (asked_rows * len(vectors))


def test_most_pairs_of_clustered_vectors_are_never_met(spark):
    """The share falls as the corpus grows; unlike vectors, all equally far, are all met."""
    rng = np.random.default_rng(2)
    spread = [_met(spark, rng.normal(size=(60, 16))[rng.integers(60, size=n)] + 0.02 * rng.normal(size=(n, 16)), 300) for n in (1000, 4000)]
    assert spread[1] < spread[0] < 0.5 and spread[1] < 0.15
    assert _met(spark, rng.normal(size=(1000, 64)), 100) > 0.9


def test_blocks_of_odd_tables(spark):
    vectors = [[1.0, 0.0], None, [0.0, 0.0], [float("nan"), 1.0], [1.0, 0.0], [0.0, 2.0]]
    asked, stored = table(spark, vectors, "qid", "float"), table(spark, vectors, "id", "float")
    found = similar(asked, stored, 2, strategy="blocks").orderBy("qid", "rank").collect()
    assert [(r.qid, r.id) for r in found] == [(0, 0), (0, 4), (4, 0), (4, 4), (5, 5), (5, 0)]
    none = stored.limit(0)
    assert similar(asked, none, 2, strategy="blocks").count() == 0
    assert similar(none.withColumnRenamed("id", "qid"), stored, 2, strategy="blocks").count() == 0


def test_crossings_start_with_the_nearest_borders():
    sets = buckets.crossings(6, 100)
    assert sets[:3] == [(), (1,), (2,)] and len(set(sets)) == 100
    assert all(len({min(j, 13 - j) for j in s}) == len(s) for s in sets)
    assert set(buckets.crossings(4, 10_000)) == set(buckets.crossings(4, 100_000))


def test_visited_cells_are_neighbours():
    """The first visit is the query's own cell, each other one differs in crossed borders only."""
    vectors = np.random.default_rng(4).normal(size=(50, 64))
    tables = buckets.Tables(64, 6, 117)
    for t in range(2):
        cells = tables.visited(vectors, t)
        assert (cells[:, 0] == tables.cells(vectors, t)).all()
        assert all(len(set(row)) == len(row) for row in cells.tolist())


def test_compared_pairs_grow_more_slowly_than_the_corpus(spark):
    """Unlike vectors, the hardest case: recall stays, the compared share falls."""
    rng, shares = np.random.default_rng(7), []
    for n in (500, 2000, 8000):
        vectors = rng.normal(size=(n, 64))
        asked, stored = table(spark, vectors[:200], "qid"), table(spark, vectors)
        found = buckets.search_corpus(asked, stored, 3, exclude_same_id=True).collect()
        near = {(r.qid, r.id) for r in found if r.qid is not None}
        exact = {(q, i) for q, i, _ in plain(vectors[:200], vectors, 3, "cosine", same=True)}
        assert len(near & exact) >= 0.9 * len(exact)
        shares.append(sum(r.compared or 0 for r in found) / (200 * n))
    assert shares[0] > shares[1] > shares[2]


def test_bundles_and_odd_rows_of_the_approximate_search(spark):
    vectors = [[1.0, 0.0], None, [0.0, 0.0], [0.9, 0.1], [0.0, 2.0]]
    asked, stored = table(spark, vectors, "qid", "float"), table(spark, vectors, "id", "float")
    for rows in (1, 4096):
        found = similar_lsh(asked, stored, 2, 0.5, query_rows=rows).orderBy("qid", "rank").collect()
        assert [(r.qid, r.id) for r in found] == [(0, 0), (0, 3), (3, 3), (3, 0), (4, 4)]
    assert similar_lsh(asked, stored.limit(0), 2).count() == 0 and similar_lsh(asked.limit(0), stored, 2).count() == 0
