"""TF-IDF vectors of texts, for corpora that come without embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _dimension(token: Column, dimensions: int) -> Column:
    head = F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long")
    return F.pmod(head, F.lit(dimensions)).cast("int")


def term_weights(texts: DataFrame, key: str, text: str, dimensions: int = 64) -> DataFrame:
    """(key, dimension, weight) with weights of unit length per text.

    Words are hashed to dimensions; counts collapse on the map side. Document
    frequencies are one row per dimension, a size known in advance."""
    words = texts.select(key, F.explode(F.split(F.lower(F.col(text)), "[ \n\t]+")).alias("w")).where(F.col("w") != "")
    tf = words.groupBy(key, _dimension(F.col("w"), dimensions).alias("dimension")).agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("dimension").agg(F.count(F.lit(1)).alias("df"))
    n = texts.agg(F.count(F.lit(1)).alias("n")).scalar()
    idf = F.log((n + F.lit(1.0)) / (F.col("df") + 1))
    # one row per dimension: `dimensions` bounds what is sent to the terms
    raw = tf.join(F.broadcast(df.select("dimension", idf.alias("idf"))), "dimension").select(
        key, "dimension", (F.col("tf") * F.col("idf")).alias("raw"))
    # a text has at most `dimensions` entries
    rows = raw.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("dimension", "raw"))).alias("t"))
    norm = F.sqrt(F.aggregate("t", F.lit(0.0), lambda acc, e: acc + e["raw"] * e["raw"]))
    return (rows.withColumn("norm", norm).where(F.col("norm") > 0)
            .select(key, "norm", F.explode("t").alias("e"))
            .select(key, "e.dimension", (F.col("e.raw") / F.col("norm")).alias("weight")))


def vectors(weights: DataFrame, key: str, dimensions: int = 64) -> DataFrame:
    """(key, embedding): the weights as dense float arrays."""
    filled = F.map_from_entries(F.collect_list(F.struct("dimension", "weight")))
    return weights.groupBy(key).agg(filled.alias("m")).select(
        key, F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)),
                         lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)).cast("float")).alias("embedding"))
