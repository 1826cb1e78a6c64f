"""All queries of the engine by name, with the SQL that an independent engine can check them by."""

from __future__ import annotations

from framewise.queries import cells, detectors, intervals, maps, models, pooled, pooling, sequence  # noqa: F401
from framewise.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
