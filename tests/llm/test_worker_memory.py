"""What a Python worker holds at once does not grow with the texts of a batch."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clientele import session
from clientele.llm import quality, toxicity
from tests.llm.data import empty_documents

SF_DIR = "/root/testdata/sf0.001"
MB = 1 << 20
SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def unset(spark):
    spark.conf.unset(SETTING)
    yield spark
    spark.conf.unset(SETTING)


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_bound_their_batches(unset, name):
    dict(corpus_pipeline.STAGES)[name](unset, empty_documents(unset), SF_DIR)
    texts = unset.range(0, 300, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield batch.assign(n=batch["text"].str.len())[["n"]].sum().to_frame().T
    found = [r["n"] for r in texts.mapInPandas(sizes, "n long").collect()]
    assert sum(found) == 300 * 100_000 and max(found) <= session.BATCH_BYTES + 100_000


def test_a_session_keeps_smaller_batches(unset):
    unset.conf.set(SETTING, "1m")
    assert session.bound_batches(unset).conf.get(SETTING) == "1m"
    unset.conf.set(SETTING, "64m")
    assert session.bound_batches(unset).conf.get(SETTING) == str(session.BATCH_BYTES)


def _scorers():
    keys = np.arange(1000, dtype=np.int64)
    own = toxicity.Sent(keys, np.zeros(len(keys), np.float32))
    return {
        "quality": quality.Model([0, 1], np.zeros((quality.BUCKETS, 2), np.float32), np.zeros(2)).posterior,
        "toxicity": toxicity.Model("", "", 0.0, np.zeros(4), own=own).ratios,
    }


@pytest.mark.parametrize("name", ["quality", "toxicity"])
def test_scoring_takes_bounded_memory(name):
    rng = np.random.default_rng(1)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz    "))
    texts = ["".join(rng.choice(letters, 3000)) for _ in range(400)]          # 1.2 million characters
    scorer = _scorers()[name]
    small = scorer(texts[:2])
    tracemalloc.start()
    try:
        found = scorer(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(found) == 400 and np.allclose(found[:2], small)
    assert peak < 48 * MB, peak / MB
