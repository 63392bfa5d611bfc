"""All queries of the library with the SQL that an independent engine runs on the same tables."""

from __future__ import annotations

from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
