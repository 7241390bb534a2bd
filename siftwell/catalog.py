"""All registered queries and their SQL."""

from __future__ import annotations

from siftwell.plans import geometry, indexing, relational, retrieval, sources, texts  # noqa: F401  registered on import
from siftwell.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
