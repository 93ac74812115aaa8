"""Imports every module that registers queries."""

from clientele.plans import answer_queries, dataset_queries, retrieval_queries, segment_queries, sketch_queries, source_queries  # noqa: F401
from clientele.plans.registry import PLANS, SQL  # noqa: F401
