"""All queries of the catalogue, and their SQL."""

from . import analyze_queries, build_queries, more_queries, scan_queries, search_queries  # noqa: F401
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
