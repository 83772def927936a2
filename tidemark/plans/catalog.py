"""All registered queries."""

from __future__ import annotations

from tidemark.plans import (  # noqa: F401
    analytics_queries,
    backtest_queries,
    feature_queries,
    insight_queries,
    market_queries,
    snapshot_queries,
    workbench_queries,
)
from tidemark.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
