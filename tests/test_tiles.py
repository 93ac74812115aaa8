"""Memory and moves of the vector search."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from clientele.functions import vectors as vec
from clientele.operators import buckets, pivots, similarity
from clientele.operators.similarity import similar
from tests.test_similarity import clustered, plain, table


@pytest.mark.parametrize("metric,threshold", [("cosine", None), ("cosine", 0.3), ("l2", None), ("ip", 1.0)])
def test_tiles_bound_the_memory_and_change_nothing(metric, threshold):
    rng = np.random.default_rng(5)
    asked, stored = rng.normal(size=(1500, 8)), rng.normal(size=(9000, 8))
    asked[3], stored[5], stored[6], stored[4000:4003] = 0, np.nan, 0, stored[8000]
    best = vec.Best(np.arange(1500), asked, 3, metric, threshold, True)
    tracemalloc.start()
    best.add(np.arange(9000), stored)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20          # one similarity matrix of 1024 x 9000 is 74 MB
    with np.errstate(invalid="ignore"):
        a, b = (vec.unit(v) if metric == "cosine" else v for v in (asked, stored))
        sim = np.nan_to_num(vec.scores(a, b, metric), nan=-np.inf)
    sim[np.arange(1500), np.arange(1500)] = -np.inf
    if threshold is not None:
        sim[sim <= threshold] = -np.inf
    for q in range(1500):
        wanted = [i for i in np.lexsort((np.arange(9000), -sim[q]))[:3] if sim[q, i] > -np.inf]
        assert best.ids[q][best.score[q] > -np.inf].tolist() == wanted


@pytest.mark.parametrize("per", [1, 3, 1000])
def test_regions_of_blocks_are_exact(spark, monkeypatch, per):
    """Blocks of 60 rows that move alone, by three, and all together."""
    monkeypatch.setattr(pivots, "REGION_ROWS", 60 * per)
    vectors = clustered(2, 700)
    found = similar(table(spark, vectors[:150], "qid"), table(spark, vectors), 3, exclude_same_id=True, strategy="blocks", block_rows=60)
    assert {(r.qid, r.id, r["rank"]) for r in found.collect()} == plain(vectors[:150], vectors, 3, "cosine", same=True)


def test_a_query_moves_once_to_a_region(spark):
    """Unlike vectors meet every block; they used to move to each of them."""
    vectors = np.random.default_rng(6).normal(size=(3000, 16))
    stored, asked = table(spark, vectors), table(spark, vectors[:100], "qid")
    schema = similarity._result_schema(asked, stored, "qid", "id")
    moved = []
    kept = pivots._meet
    try:
        pivots._meet = lambda queries, *more: moved.append(queries.count()) or kept(queries, *more)
        pivots.search(asked, stored, schema, similarity._arrow(schema), dict(k=3, metric="cosine", threshold=None, exclude_same_id=True), 50)
    finally:
        pivots._meet = kept
    assert sum(moved) <= 100 * 4


def test_blocks_within_groups_are_not_copied_for_every_few_rows(spark):
    vectors = clustered(3, 600)
    rows = table(spark, vectors).withColumn("label", F.col("id") % 2)
    asked = rows.withColumnRenamed("id", "qid")
    found = similar(asked, rows, 3, exclude_same_id=True, pre_filter=["label"], strategy="blocks", block_rows=20)
    known = similar(asked, rows, 3, exclude_same_id=True, pre_filter=["label"])
    assert found.exceptAll(known).count() == 0 and found.count() == known.count()
    assert similarity.MOVED_ROWS >= 1024


def test_visits_are_those_of_the_template():
    """Summed by borders they are what the product with the template is, which is made once."""
    tables = buckets.Tables(32, 7, 400)
    asked = np.random.default_rng(8).normal(size=(60, 32))
    sets, names = buckets.crossings(7, 400), tables._names()[1]
    at = tables.places(asked, 1)
    borders = np.argsort(np.concatenate([at - np.floor(at), 1 - (at - np.floor(at))], axis=1), axis=1, kind="stable")
    wanted = [[int(c) + sum(int(np.concatenate([-names, names])[borders[q, j - 1]]) for j in s) for s in sets]
              for q, c in enumerate(tables.cells(asked, 1))]
    assert [[w & (2 ** 64 - 1) for w in row] for row in wanted] == tables.visited(asked, 1).astype(np.uint64).tolist()
    assert buckets.crossings(7, 400) is sets


def test_single_precision_decides_nothing():
    """Vectors that differ by less than single precision, exact copies, a floor and few queries for some rows."""
    rng = np.random.default_rng(9)
    stored = rng.normal(size=(3000, 16))
    stored[1000:1500] = stored[7] + 1e-8 * rng.normal(size=(500, 16))
    stored[2000:2400] = stored[7]
    asked = np.concatenate([stored[[7, 1000, 2000]] + 1e-9, rng.normal(size=(200, 16))])
    sim = np.round(vec.unit(asked) @ vec.unit(stored).T, vec.DIGITS)
    sim[np.arange(203), np.arange(203)] = -np.inf
    best = vec.Best(np.arange(203), asked, 3, "cosine", None, True, floor=np.where(np.arange(203) < 100, 0.5, np.nan))
    shuffled = rng.permutation(3000)
    half = np.arange(0, 203, 2)
    best.add(shuffled[:1000], stored[shuffled[:1000]])
    best.add_parts(shuffled[1000:], stored[shuffled[1000:]], [(0, 5, None), (5, 900, half), (5, 900, half[:-1] + 1), (900, 2000, None)])
    sim[:100][sim[:100] < 0.5] = -np.inf
    for q in range(203):
        wanted = [i for i in np.lexsort((np.arange(3000), -sim[q]))[:3] if sim[q, i] > -np.inf]
        assert best.ids[q][best.score[q] > -np.inf].tolist() == wanted
    assert (vec._places(sim > 0.7) == np.flatnonzero(sim > 0.7)).all()


def test_many_pairs_that_wait_are_thinned_out_by_query(monkeypatch):
    """Numbers of queries may be short integers; the k-th of each is to be its own."""
    monkeypatch.setattr(vec, "SCORED", 500)
    rng = np.random.default_rng(14)
    asked, stored = rng.normal(size=(300, 8)), rng.normal(size=(200, 8))
    best = vec.Best(np.arange(300), asked, 3, "cosine", -0.5, False)
    best.add_parts(np.arange(200), stored, [(a, a + 10, rng.permutation(300).astype(np.int32)) for a in range(0, 200, 10)])
    sim = np.round(vec.unit(asked) @ vec.unit(stored).T, vec.DIGITS)
    assert [set(row) for row in best.ids.tolist()] == [set(np.argsort(-row)[:3].tolist()) for row in sim]


def test_bundles_are_searched_at_once(spark):
    """They used to pass the driver and the index one after the other."""
    vectors = np.random.default_rng(10).normal(size=(400, 16))
    context = spark.sparkContext
    context.setJobGroup("bundles", "")
    try:
        buckets.search_corpus(table(spark, vectors, "qid"), table(spark, vectors), 3, query_rows=10)
        assert len(context.statusTracker().getJobIdsForGroup("bundles")) < 30
    finally:
        context.setJobGroup("other", "")


def test_shards_meet_the_visited_cells(spark, monkeypatch):
    """Shards of 100 rows, among them a cell that fills several; the pairs are those of the template."""
    monkeypatch.setattr(buckets, "SHARD_ROWS", 100)
    vectors = np.random.default_rng(12).normal(size=(900, 16))
    vectors[::3] = vectors[0]
    asked, stored = table(spark, vectors[:250], "qid"), table(spark, vectors)
    found = buckets.search_corpus(asked, stored, 3, 0.2, exclude_same_id=True, query_rows=60).collect()
    tables = buckets.tables_for(stored)
    met = [np.isin(tables.cells(vectors, t), tables.visited(vectors[q:q + 1], t)) for t in range(2) for q in range(250)]
    assert sum(r.compared or 0 for r in found) == sum(m.sum() for m in met)
    sim = np.round(vec.unit(vectors[:250]) @ vec.unit(vectors).T, vec.DIGITS)
    sim[np.arange(250), np.arange(250)] = -np.inf
    near = {}
    for r in found:
        if r.qid is not None:
            near.setdefault(r.qid, set()).add((-r.similarity, r.id))
    for q in range(250):
        some = np.flatnonzero((met[q] | met[250 + q]) & (sim[q] > 0.2))
        assert [i for _, i in sorted(near.get(q, ()))[:3]] == [int(i) for i in some[np.lexsort((some, -sim[q, some]))][:3]]


def test_rows_beyond_the_best_so_far_are_left_out(spark, monkeypatch):
    """Every region used to return its k best of every query."""
    monkeypatch.setattr(pivots, "REGION_ROWS", 100)
    monkeypatch.setattr(pivots, "MOST_ROWS", 100)
    vectors = np.random.default_rng(13).normal(size=(3000, 16))
    asked, stored = table(spark, vectors[:50], "qid"), table(spark, vectors)
    schema = similarity._result_schema(asked, stored, "qid", "id")
    found = pivots.search(asked, stored, schema, similarity._arrow(schema), dict(k=3, metric="cosine", threshold=None, exclude_same_id=True), 100)
    assert found.count() < 50 * 3 * 20
    best = similarity._ranked(found, 3).collect()
    assert {(r.qid, r.id, r["rank"]) for r in best} == plain(vectors[:50], vectors, 3, "cosine", same=True)
