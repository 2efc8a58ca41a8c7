"""Registered queries: every operator on the given tables, with SQL beside it."""

from . import (aggregates, columns, detections, families, lifecycle, lookups, predicates, ranking, sources,  # noqa: F401
               streams)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
