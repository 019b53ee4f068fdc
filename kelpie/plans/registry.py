"""Every registered query with its DuckDB SQL."""

from __future__ import annotations

from kelpie.plans import layout_queries, metric_queries, scale_queries, scans, stream_queries  # noqa: F401
from kelpie.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
