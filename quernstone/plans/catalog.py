"""All registered queries of the engine."""

from __future__ import annotations

from . import analytics, retrieval, scalars, stored
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "analytics", "retrieval", "scalars", "stored"]
