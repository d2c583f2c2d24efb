"""All registered queries."""

from . import cascade_queries, decision_queries, extractor_queries, gate_queries, page_queries  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
