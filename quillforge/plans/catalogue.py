"""All queries by name, with DuckDB SQL for the same rows."""

from __future__ import annotations

from quillforge.plans import coverage_queries, graph_queries, report_queries, text_queries
from quillforge.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "coverage_queries", "graph_queries", "report_queries", "text_queries"]
