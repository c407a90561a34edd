"""Registered queries, the recipes that derive their inputs, and their SQL oracles."""

from . import dates, details, diffs, links, pages, scans  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
