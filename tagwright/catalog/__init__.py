"""Registered queries and their SQL twins."""

from tagwright.catalog import encodings, lookups, modelling, sources  # noqa: F401
from tagwright.catalog.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
