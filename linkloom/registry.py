"""Queries by operator name, and the SQL of each that SQL can express."""

from __future__ import annotations

from .plans import inventory  # noqa: F401  (registers)
from .plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
