"""Registered queries: each applies an operator to the given tables, beside SQL that must give the same rows."""

from . import accounts, changelog, databases, filters, shapes, sync, values  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
