"""All queries over the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from rippleframe.plans import code_queries, comod_queries, compound_queries, eval_queries, gap_queries, graph_queries, history_queries, rank_queries, text_queries  # noqa: F401
from rippleframe.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
