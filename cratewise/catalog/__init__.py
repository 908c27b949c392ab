"""Registered queries: library operators over the given tables, each with SQL to check it by."""

from .registry import QUERIES, SQL
from . import vectors, reads, profiles, sequences, search, labels, edits, keys, sources, streams  # noqa: F401  (registration)

__all__ = ["QUERIES", "SQL"]
