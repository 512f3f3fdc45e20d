"""All registered queries of the log operators, and their SQL."""

from __future__ import annotations

from . import cases, formats, queries

QUERIES = queries.QUERIES | formats.QUERIES | cases.QUERIES
ORACLE_SQL = queries.ORACLE_SQL | formats.ORACLE_SQL | cases.ORACLE_SQL
