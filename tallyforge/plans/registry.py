"""All event-analytics queries and their DuckDB statements."""

from __future__ import annotations

from . import files, learning, metrics, models, money  # noqa: F401  they register their queries
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
