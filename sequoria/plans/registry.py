"""All queries of the engine and their SQL, by name."""

from __future__ import annotations

from . import cleaning_queries, fusion_queries, metric_queries, sequence_queries, source_queries, split_queries
from .base import oracle_sql, queries

__all__ = ["cleaning_queries", "fusion_queries", "metric_queries", "oracle_sql", "queries", "sequence_queries", "source_queries", "split_queries"]
