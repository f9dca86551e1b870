"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from . import contracts, history, items, joins, more, pages, profile, ranking, readings, relations, scalars, scans, sinks, stories, streams, tagging  # noqa: F401

from .base import ORACLE_SQL, QUERIES

FLAGSHIP = "near_duplicate_pairs"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
