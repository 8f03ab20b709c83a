"""Queries over the verification tables, each with the SQL that says the same where SQL can."""

from __future__ import annotations

from . import structure, media, tables, assembly, logs, streams, details, rules  # noqa: F401, I001  (they register their queries)
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
