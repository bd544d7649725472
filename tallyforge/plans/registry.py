"""Queries of the engine over the driver's tables, and their SQL."""

from __future__ import annotations

from . import derived  # noqa: F401
from .queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
