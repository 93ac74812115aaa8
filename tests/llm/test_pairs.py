"""Joins and searches against brute force."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from clientele.llm import covertree, graph, ngramjoin, permindex, queries
from tests.llm.data import CLASHES, DOCS, empty_documents, odd_documents, prose


def union(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + 4]) for i in range(len(words) - 3)} if len(words) >= 4 else {tuple(words)} - {()}


def check_join(spark, docs, tmp_path):
    rows = docs.select("doc_id", "text").collect()
    sets = [shingles(r["text"]) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    roots = union(len(rows), links)
    names = {}
    for i, root in enumerate(roots):
        if rows[i]["doc_id"] is not None:
            names[root] = min(names.get(root, 1 << 60), rows[i]["doc_id"])
    expected = sorted((r["doc_id"] or 0, len(s), names.get(root, 0)) for r, s, root in zip(rows, sets, roots, strict=True))
    got = ngramjoin.joined(docs, str(tmp_path / "join"))
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in got.collect()) == expected
    return got, links


def test_join_of_odd_rows(spark, tmp_path):
    got, _ = check_join(spark, odd_documents(spark), tmp_path)
    assert set(CLASHES) - {"j"} <= set(got.columns)
    assert ngramjoin.joined(empty_documents(spark), str(tmp_path / "e")).count() == 0


@pytest.mark.parametrize("block", [4096, 4])
def test_join_of_clouds_chains_and_shared_passages(spark, tmp_path, monkeypatch, block):
    """Copies that link through a third one only, chains of edits, a passage that many
    unrelated texts share, and cells that have to be dealt out."""
    monkeypatch.setattr(ngramjoin, "CELL_BLOCK", block)
    rng, texts = np.random.default_rng(2), []
    base = prose(1, 100).split()
    for k in range(25):                                   # a cloud around one text
        copy = list(base)
        for at in rng.choice(100, rng.integers(1, 4), replace=False):
            copy[at] = f"edit{k}"
        texts.append(" ".join(copy))
    chain = prose(2, 80).split()
    for k in range(20):                                   # a drift, one word at a time
        chain[(7 * k) % 80] = f"drift{k}"
        texts.append(" ".join(chain))
    passage = prose(3, 60)
    texts += [f"{prose(100 + k, 40)} {passage} {prose(200 + k, 30)}" for k in range(20)]
    texts += [f"{passage} {prose(300 + k, 5)}" for k in range(12)] + [prose(400 + k, 3) for k in range(5)] + [prose(400, 3)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS).repartition(3)
    _, links = check_join(spark, docs, tmp_path)
    assert len(links) > 50


def test_shared_keys_across_batches():
    """Cells are found alike wherever batches are cut."""
    import pandas as pd
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"key": np.sort(rng.integers(0, 30, 60)), "id": rng.permutation(60), "n": 5}).sort_values(["key", "id"])
    sizes = frame.groupby("key")["id"].transform("size")
    expected = frame[sizes > 1]
    heads = frame.groupby("key")["id"].transform("first")[sizes > 1]
    for cut in (1, 2, 7, 60):
        parts = [frame.iloc[i:i + cut] for i in range(0, 60, cut)]
        got = pd.concat(list(ngramjoin._shared_keys(iter(parts))))
        assert got["id"].tolist() == expected["id"].tolist() and got["head"].tolist() == heads.tolist()


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(i, i + 1) for i in range(400, 460)] + [(900, 900)]
    frame = spark.createDataFrame([*links, (None, 1)], "a long, b long")
    roots = union(901, links)
    got = {r["id"]: r["component"] for r in graph.components(frame).collect()}
    assert got == {i: roots[i] for pair in links for i in pair}
    assert graph.components(frame.limit(0)).count() == 0


def test_a_round_of_components_moves_three_times(spark, tmp_path):
    """Star by star and the different edges: no broadcast, and no star is made twice."""
    spark.range(50).selectExpr("id + 1 as a", "id as b").write.parquet(str(tmp_path / "edges"))
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plan = graph._round(spark.read.parquet(str(tmp_path / "edges")))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)
    moves = [line for line in plan.splitlines() if "Exchange " in line]
    assert "Broadcast" not in plan
    # both sides of the large star, the small star (its other side is reused) and the result
    assert sum("ReusedExchange" not in line for line in moves) == 4 and len(moves) == 5, plan


def odd_vectors(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + rng.normal(size=16) * (0.02, 0.12, 0.3)[i % 3]).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(8)] + [(0, rows[0][1])]                  # copies, and a repeated row
    rows += [(400, None), (401, [0.0] * 16), (402, [float("nan")] * 16), (403, [None] + [1.0] * 15), (404, []), (405, [1.0]),
             (406, [float("inf")] * 16), (None, rows[5][1]), (407, [2 * x for x in rows[1][1]])]
    return spark.createDataFrame([(i, v, 0, "clash") for i, v in rows], "vec_id long, embedding array<float>, label int, cell string")


def usable(v, width=16):
    return v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("cell", [4096, 40])
def test_near_vectors(spark, cell):
    frame = odd_vectors(spark)
    rows = frame.collect()
    ok = [i for i, r in enumerate(rows) if usable(r["embedding"]) and r["vec_id"] is not None]
    unit = np.stack([np.array(rows[i]["embedding"], float) for i in ok])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    links = [(ok[i], ok[j]) for i, j in zip(*np.nonzero(near), strict=True) if i != j]
    count = np.bincount([a for a, _ in links], minlength=len(rows))
    roots, name = union(len(rows), links), {}
    for i, root in enumerate(roots):
        if rows[i]["vec_id"] is not None:
            name[root] = min(name.get(root, 1 << 60), rows[i]["vec_id"])
    expected = sorted((r["vec_id"] if r["vec_id"] is not None else -1, int(n), name.get(root, -1))
                      for r, n, root in zip(rows, count, roots, strict=True))
    got = covertree.near_vectors(frame, cell_vectors=cell).collect()
    assert sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["n_links"],
                   r["component_id"] if r["component_id"] is not None else -1) for r in got) == expected
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got if r["vec_id"] is not None)
    assert covertree.near_vectors(frame.limit(0)).count() == 0


def nearest(rows, query, k):
    """Plain search: (distance, id) of the k nearest of all other ids."""
    q = np.array(query["embedding"], float)
    found = sorted((float(np.sqrt(((np.array(r["embedding"], float) - q) ** 2).sum())), r["vec_id"]) for r in rows
                   if usable(r["embedding"], len(q)) and r["vec_id"] is not None and r["vec_id"] != query["vec_id"])
    return found[:k]


def test_search_of_odd_vectors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(permindex, "QUERIES", 2)
    frame = odd_vectors(spark)
    pivots = permindex.build_index(frame, str(tmp_path / "i"))
    index = spark.read.parquet(str(tmp_path / "i"))
    got = permindex.search(index, pivots, frame.where("vec_id % 100 = 0"), str(tmp_path / "f")).orderBy("query_id", "rank").collect()
    rows = frame.collect()
    for q in (0, 100, 200, 300):
        mine = [(r["score"], r["vec_id"]) for r in got if r["query_id"] == q]
        assert mine == nearest(rows, next(r for r in rows if r["vec_id"] == q), 10)      # a small block is compared whole
    assert {r["query_id"] for r in got} == {0, 100, 200, 300}
    empty = permindex.build_index(frame.limit(0), str(tmp_path / "e"))
    assert permindex.search(spark.read.parquet(str(tmp_path / "e")), empty, frame.limit(0), str(tmp_path / "g")).count() == 0


def test_recall_on_the_largest_table(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = queries.read(spark, sf_dir, "embeddings").toPandas().sort_values("vec_id")
    points, ids = np.stack(rows["embedding"]).astype(float), rows["vec_id"].to_numpy()
    got = queries.approximate_neighbours(spark, sf_dir).toPandas()
    hits = total = 0
    for q, own in got.groupby("query_id"):
        far = np.sqrt(((points - points[np.searchsorted(ids, q)]) ** 2).sum(axis=1))
        far[ids == q] = np.inf
        best = ids[np.lexsort((ids, far))[:10]]
        own = own.sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11))
        assert np.allclose(own["score"], far[np.searchsorted(ids, own["vec_id"])], rtol=0, atol=0)
        hits, total = hits + len(set(best) & set(own["vec_id"])), total + 10
    assert total == 10 * (ids % 100 == 0).sum() and hits / total >= 0.95
