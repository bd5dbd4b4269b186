"""Runnable queries over the given tables."""

from paneloom.queries import (  # noqa: F401
    model_queries, panel_queries, statistic_queries, table_queries, window_queries,
)
from paneloom.queries.base import REGISTRY

__all__ = ["REGISTRY"]
