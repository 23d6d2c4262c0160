"""Registered queries. Importing this package registers all of them."""

from . import exact_queries, graph_queries, more_queries, relational_queries, stats_queries, stream_queries, text_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "exact_queries", "graph_queries", "more_queries", "relational_queries", "stats_queries", "stream_queries", "text_queries"]
