"""The corpus pipeline: documents through scoring, joining, mixing and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it as
Parquet and reads it again for the next one. All stages but the last return the columns
of documents. Models learn from the documents and labels of `sf_dir`; what they are
applied to is what the stage before has kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clientele.llm import mixing, ngramjoin, packing, quality, toxicity
from clientele.llm.queries import FLAGGED, WEIGHTS, domain_model, read, tokenizer_path
from clientele.session import free_tasks, scratch_dir, tune

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier gives at least 0.5; others go."""
    free_tasks(tune(spark))
    model = quality.quality_model(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return docs.where(quality.score(model, 1) >= 0.5).select(*COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below 0.3; others go."""
    free_tasks(tune(spark))
    model = toxicity.toxicity_model(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return toxicity.scored(docs.select(*COLUMNS), model).where("score < 0.3").select(*COLUMNS)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id. A
    document without words is in no group and stays. Rows that repeat a doc_id and have
    words leave one; without doc_id a row stays."""
    free_tasks(tune(spark))
    found = ngramjoin.joined(docs.select(*COLUMNS), scratch_dir(spark, "pipeline-jaccard"))
    kept = found.where((F.col("doc_id") == F.col("component_id")) | (F.col("n_shingles") == 0) | F.col("doc_id").isNull())
    # the least of repeated rows as one struct: a text travels once
    alone = kept.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.min(F.struct("text", "lang", "source", "n_chars")).alias("_row")).select("doc_id", "_row.*")
    rest = kept.where((F.col("n_shingles") == 0) | F.col("doc_id").isNull())
    return rest.select(*COLUMNS).unionByName(alone.select(*COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its rate says, so that the expected tokens of the
    domains match the target weights. No language has to lose tokens."""
    free_tasks(tune(spark))
    found = mixing.mixed(docs.select(*COLUMNS), domain_model(spark, sf_dir), WEIGHTS, tokenizer_path(),
                         scratch_dir(spark, "pipeline-mixing"), shrinking=(FLAGGED,))
    return found.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in the sequences."""
    free_tasks(tune(spark))
    return packing.packed_documents(docs, tokenizer_path(), scratch_dir(spark, "pipeline-pieces"))


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("jaccard", jaccard_stage),
          ("mixing", mixing_stage), ("packing", packing_stage)]
# The first two stages are trained models, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
