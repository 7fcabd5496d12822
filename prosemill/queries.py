"""All queries of the engine by name, and their SQL."""

from __future__ import annotations

from prosemill.plans import corpus_queries, decision_queries, evaluation_queries, judging_queries, page_queries, stream_queries, text_queries  # noqa: F401
from prosemill.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
