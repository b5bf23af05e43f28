"""Registered queries, one module per operator family."""

from larkspur.plans.registry import CHECK_SQL, QUERIES
from larkspur.plans import (  # noqa: F401  (importing registers the queries)
    source_queries, relational_queries, stat_queries, window_queries, scalar_queries, label_queries, text_queries, stream_queries,
)

__all__ = ["CHECK_SQL", "QUERIES"]
