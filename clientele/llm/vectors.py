"""Which embeddings take part, and their Arrow form."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

USABLE = ("embedding is not null and size(embedding) > 0 "
          "and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) "
          "and exists(embedding, x -> x <> 0)")


def usable() -> Column:
    """Neither null nor zero, all components present and finite."""
    return F.coalesce(F.expr(USABLE), F.lit(False))


def matrix(column) -> np.ndarray:
    """Array components of a batch, in double precision."""
    return np.stack([np.asarray(x, np.float64) for x in column]) if len(column) else np.zeros((0, 0))


def widest(vectors: DataFrame) -> int:
    """The number of components that most vectors have; shorter or longer ones cannot
    be compared. Ties go to the larger number."""
    row = vectors.where(usable()).groupBy(F.size("embedding").alias("n")).count().orderBy(
        F.desc("count"), F.desc("n")).first()
    return row["n"] if row else 0
