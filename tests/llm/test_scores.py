"""The classifiers: held-out accuracy on the provided tables, and odd rows."""

import zlib

import numpy as np
import pytest

from clientele.llm import mixing, quality, queries, toxicity
from tests.llm.data import TOKENIZER, empty_documents, odd_documents

SF_DIR = "/root/testdata/sf0.1"


def tables(spark):
    return queries.read(spark, SF_DIR, "documents"), queries.read(spark, SF_DIR, "labels")


@pytest.fixture(scope="module")
def models(spark):
    docs, labels = tables(spark)
    return quality.quality_model(docs, labels), toxicity.toxicity_model(docs, labels), queries.domain_model(spark, SF_DIR)


@pytest.mark.parametrize("which, column, modulus, remainder, least", [(0, "quality", 3, 1, 0.99), (1, "toxic", 4, 2, 0.97)])
def test_held_out_accuracy(spark, models, which, column, modulus, remainder, least):
    docs, labels = tables(spark)
    score = (quality.score_quality, toxicity.score_toxicity)[which]
    rows = score(docs, models[which]).join(labels, "doc_id").toPandas()
    held = np.array([zlib.crc32(str(i).encode()) % modulus == remainder for i in rows["doc_id"]])
    assert (held == rows["held_out"]).all() and held.any()
    right = rows["predicted"] == rows[column]
    assert right[held].mean() >= least
    minority = 0 if column == "quality" else 1
    assert right[held & (rows[column] == minority)].mean() >= 0.9
    assert right[held & (rows[column] != minority)].mean() >= 0.99


@pytest.mark.parametrize("which", [0, 1])
def test_odd_rows_are_scored(spark, models, which):
    score = (quality.score_quality, toxicity.score_toxicity)[which]
    rows = score(odd_documents(spark), models[which]).collect()
    assert len(rows) == 15 and all(0 <= r["score"] <= 1 for r in rows)
    by_id = {r["doc_id"]: r["score"] for r in rows}
    assert by_id[5] == by_id[6] and len({r["score"] for r in rows if r["doc_id"] == 3}) == 1
    assert score(empty_documents(spark), models[which]).count() == 0


def test_models_without_usable_labels(spark):
    docs = odd_documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 0), (3, 1, 0), (None, 0, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        for model, score in ((quality.quality_model, quality.score_quality), (toxicity.toxicity_model, toxicity.score_toxicity)):
            rows = score(docs, model(docs, labels)).collect()
            assert len(rows) == 15 and all(0 <= r["score"] <= 1 for r in rows)


def test_rates_are_those_of_plain_projected_gradient(spark, tmp_path):
    rng = np.random.default_rng(3)
    p, tokens = rng.dirichlet([0.3] * 3, 200), rng.integers(0, 500, 200)
    names, weights = ["x", "y", "z"], {"x": 0.5, "y": 0.3, "z": 0.2}
    members = spark.createDataFrame([(i, int(t), [float(v) for v in q]) for i, (t, q) in enumerate(zip(tokens, p))],
                                    "doc_id long, n_tokens long, p array<double>")
    rows = members.withColumn("r", mixing.fit_rates(members, names, weights)).orderBy("doc_id").collect()
    got = np.array([r["r"] for r in rows])
    held = tokens @ p
    want = np.array([0.5, 0.3, 0.2]) * max(held / np.array([0.5, 0.3, 0.2]))
    r = np.ones(200)
    for _ in range(2000):
        r = np.maximum(0, r - p @ (((r * tokens) @ p - want) / held))
    assert (got >= 0).all() and np.allclose((got * tokens) @ p, (r * tokens) @ p, rtol=0.01)
    assert np.allclose((got * tokens) @ p, want, rtol=0.01)


def test_mixing_of_odd_rows(spark, models, tmp_path):
    rows = mixing.mixed(odd_documents(spark), models[2], queries.WEIGHTS, TOKENIZER, str(tmp_path / "m")).collect()
    assert len(rows) == 15 and all(abs(sum(r["p"]) - 1) < 1e-6 and r["rate"] >= 0 and r["copies"] >= 0 for r in rows)
    assert {r["n_tokens"] for r in rows if r["text"] in (None, "")} == {0} and rows[0]["a"] == "clash"
    assert mixing.mixed(empty_documents(spark), models[2], queries.WEIGHTS, TOKENIZER, str(tmp_path / "e")).count() == 0
