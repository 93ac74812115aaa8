"""Labelled rows of a documents table, the held-out rule, and bounded samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# A label table of up to so many rows (about 64 MB) is sent to the documents; a larger
# one meets them in a shuffle. Both give the same rows.
SENT_LABELS = 4_000_000


def held_out(modulus: int, remainder: int):
    """True for rows that no model may learn from: crc32 of doc_id as text."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def clean_labels(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label): null ids and labels go; of several labels the largest counts."""
    return (labels.select("doc_id", F.col(column).cast("int").alias("label")).dropna()
            .groupBy("doc_id").agg(F.max("label").alias("label")))


def with_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs(doc_id, text) that have a label."""
    small = labels.limit(SENT_LABELS + 1).count() <= SENT_LABELS
    return docs.join(F.broadcast(labels) if small else labels, "doc_id")


def sample_by_class(labels: DataFrame, classes: list, rows: int) -> DataFrame:
    """At most `rows` labels of each class, chosen by a hash of doc_id."""
    parts = [labels.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for c in classes]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
