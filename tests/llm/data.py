"""Small tables with every odd case: nulls, empty and long texts, repeated rows, extra
columns whose names the operators use themselves."""

from __future__ import annotations

import random

import public_tokenizers
from pyspark.sql import functions as F

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["j", "row", "n", "node", "keys", "p", "rate", "copies", "score", "rank", "id", "a", "b", "label", "component",
           "n_shingles", "component_id", "n_tokens", "length", "block", "fold", "digest", "kind", "part", "copy", "member"]


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(2, 7))) for _ in range(words))


def odd_documents(spark, clashes: bool = True):
    """Two long texts that differ little, repeated rows, ties, null ids and texts."""
    long = prose(1, 30_000)
    rows = [(1, long), (2, long.replace("a", "e", 40)), (3, prose(3, 120)), (3, prose(3, 120)), (4, prose(3, 120)),
            (5, None), (6, ""), (7, " \t\n"), (8, "One two"), (9, "one TWO"), (10, "é中文 \U0001F600 ß"), (None, prose(3, 120)),
            (None, None), (11, prose(11, 50)), (12, "word " * 400)]
    docs = spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, None, None if t is None else len(t)) for i, t in rows], DOCS)
    return docs.withColumns({c: F.lit("clash") for c in CLASHES}) if clashes else docs


def empty_documents(spark):
    return spark.createDataFrame([], DOCS)
