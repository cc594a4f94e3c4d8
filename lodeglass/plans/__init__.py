"""Registered queries."""

from lodeglass.plans import logs, pods, resources  # noqa: F401
from lodeglass.plans.registry import QUERIES, Query, Tables

__all__ = ["QUERIES", "Query", "Tables"]
