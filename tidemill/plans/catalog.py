"""All queries, by importing the modules that register them."""

from __future__ import annotations

from . import function_queries, page_queries, relation_queries, search_queries, source_queries, state_queries, stats_queries, stream_queries, training_queries, vector_queries  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
