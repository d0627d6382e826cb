"""All registered queries and their SQL."""

from __future__ import annotations

from tesserae.plans import code_queries, dedup_queries, feature_queries, graph_queries, judging_queries, learn_queries, line_queries, more_queries, state_queries, verdict_queries
from tesserae.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "code_queries", "dedup_queries", "feature_queries", "graph_queries", "judging_queries", "learn_queries", "line_queries", "more_queries", "state_queries", "verdict_queries"]
