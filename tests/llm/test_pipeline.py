"""The pipeline: every stage on odd rows, and its decisions on the provided tables."""

import corpus_pipeline
from clientele.llm import queries, quality, toxicity
from tests.llm.data import empty_documents, odd_documents
from tests.llm.test_files import check_packing

SF_DIR = "/root/testdata/sf0.01"


def test_stages_on_odd_and_empty_rows(spark):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for docs, most in ((odd_documents(spark), 15), (empty_documents(spark), 0)):
            out = stage(spark, docs, SF_DIR)
            assert out.columns == corpus_pipeline.COLUMNS, name
            assert name == "mixing" or out.count() <= most
    assert corpus_pipeline.STAGES[-1][1](spark, odd_documents(spark), SF_DIR).count() > 0


def test_stages_decide(spark):
    docs, labels = queries.read(spark, SF_DIR, "documents"), queries.read(spark, SF_DIR, "labels")
    ids = lambda frame: {r["doc_id"] for r in frame.select("doc_id").collect()}
    every, stages = ids(docs), dict(corpus_pipeline.STAGES)
    good = ids(quality.score_quality(docs, quality.quality_model(docs, labels)).where("predicted = 1"))
    assert ids(stages["quality"](spark, docs, SF_DIR)) == good < every
    toxic = ids(toxicity.score_toxicity(docs, toxicity.toxicity_model(docs, labels)).where("predicted = 1"))
    assert ids(stages["toxicity"](spark, docs, SF_DIR)) == every - toxic and toxic
    joined = queries.ngram_jaccard_join(spark, SF_DIR)
    assert ids(stages["jaccard"](spark, docs, SF_DIR)) == ids(joined.where("doc_id = component_id")) < every
    mixed = stages["mixing"](spark, docs, SF_DIR)
    copies = {r["doc_id"]: r["copies"] for r in queries.mixing_rates(spark, SF_DIR).collect()}
    got = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert got == {i: c for i, c in copies.items() if c} and max(got.values()) > 1


def test_run_packs_what_is_kept(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    docs = {r["doc_id"]: r["text"] for r in queries.read(spark, "/root/testdata/sf0.001", "documents").collect()}
    first = [r["doc_id"] for r in rows if r["piece"] == 0]
    check_packing(rows, [(i, docs[i]) for i in first])
