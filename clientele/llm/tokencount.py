"""Token counts of documents in flat token files that have no index.

A file is nothing but ids; an end-of-document id closes each document. Blocks of all
files are searched at once, in numpy; a prefix scan over the blocks of a file says how
many documents end before a block and where the last of them ended.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from clientele.llm import files
from clientele.llm.bpe import byte_pairs

SUFFIX = ".ids"
BLOCK_TOKENS = 1 << 20


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, eod: int, kind: str = "<u2") -> DataFrame:
    """Encode docs(doc_id, text) into one flat file per task, in the order of the rows,
    each text followed by `eod`. Returns (file, ordinal, doc_id). Null text is empty.
    Names of special tokens inside a text are ordinary text, so only the ends carry
    `eod`. The same rows in the same partitions give the same files. Tasks without
    rows write no file; other columns are left out."""
    files.make_folder(folder)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, name, ordinal = byte_pairs(tokenizer, ordinary=True), f"part-{TaskContext.get().partitionId():05d}{SUFFIX}", 0
        batch = next(batches, None)
        if batch is None:
            return
        with files.committed(folder, name) as out:
            while batch is not None:
                for ids in pairs.encode([t if isinstance(t, str) else "" for t in batch["text"]]):
                    out.write(np.append(ids, eod).astype(kind).tobytes())
                yield pd.DataFrame({"file": name, "ordinal": np.arange(ordinal, ordinal + len(batch)),
                                    "doc_id": batch["doc_id"]})
                ordinal += len(batch)
                batch = next(batches, None)

    return docs.select("doc_id", "text").mapInPandas(write, "file string, ordinal long, doc_id long")


def scan_separators(spark: SparkSession, folder: str, eod: int, kind: str = "<u2",
                    block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, ordinal, start, n_tokens, closed) of every document in the files of
    `folder`: `start` counts ids before it, `n_tokens` leaves the separator out.

    Ids after the last separator of a file form a document with closed = false.
    Neighbouring separators enclose an empty document. An empty file or folder gives
    no row. Files may have any length; a block is the unit of work and of memory."""
    width = np.dtype(kind).itemsize
    found = [(name, size // width) for name, size in files.sizes(folder, SUFFIX)]
    listing = spark.createDataFrame(found, "file string, ids long")
    blocks = listing.where("ids > 0").select("file", "ids", F.explode(F.sequence(
        F.lit(0).cast("long"), F.expr(f"(ids - 1) div {block_tokens}"))).alias("block"))
    # blocks are dealt evenly whatever file they belong to
    tasks = max(1, sum(-(-ids // block_tokens) for _, ids in found))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, block in zip(batch["file"], batch["block"], strict=True):
                with files.open_file(folder, name) as stream:
                    stream.seek(int(block) * block_tokens * width)
                    raw = stream.read(block_tokens * width)
                ids = np.frombuffer(raw, kind, len(raw) // width)
                at = np.flatnonzero(ids == eod) + int(block) * block_tokens
                yield pd.DataFrame({"file": [name], "block": [block], "stop": [int(block) * block_tokens + len(ids)],
                                    "ends": [at]})

    searched = blocks.repartition(min(tasks, spark.sparkContext.defaultParallelism * 4), "file", "block") \
        .select("file", "block").mapInPandas(search, "file string, block long, stop long, ends array<long>")
    # the prefix scan; rows are blocks, not ids
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stitched = searched.select(
        "file", "block", "stop", "ends",
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("ended"),
        F.coalesce(F.max(F.try_element_at("ends", F.lit(-1))).over(before) + 1, F.lit(0)).alias("carry"),
        (F.max("stop").over(whole) == F.col("stop")).alias("last"))
    closed = stitched.select("file", "ended", "carry", "ends", F.posexplode("ends").alias("k", "end")).select(
        "file", (F.col("ended") + F.col("k")).alias("ordinal"),
        F.when(F.col("k") == 0, F.col("carry")).otherwise(F.get("ends", F.col("k") - 1) + 1).alias("start"), "end")
    tail = stitched.where("last").select(
        "file", (F.col("ended") + F.size("ends")).alias("ordinal"),
        F.coalesce(F.try_element_at("ends", F.lit(-1)) + 1, F.col("carry")).alias("start"),
        F.col("stop").alias("end")).where("end > start")
    return closed.withColumn("closed", F.lit(True)).unionByName(tail.withColumn("closed", F.lit(False))).select(
        "file", "ordinal", "start", (F.col("end") - F.col("start")).alias("n_tokens"), "closed")
