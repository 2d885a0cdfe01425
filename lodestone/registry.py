"""Every query that the library registers, with SQL to hold it against."""

from __future__ import annotations

from lodestone.oracle import ORACLE_SQL
from lodestone.queries import QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
