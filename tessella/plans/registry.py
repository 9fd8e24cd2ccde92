"""All registered queries of the library itself, and their SQL."""

from __future__ import annotations

from . import catalog, recordings, records, signals

QUERIES = catalog.QUERIES | signals.QUERIES | records.QUERIES | recordings.QUERIES
ORACLE_SQL = catalog.ORACLE_SQL | signals.ORACLE_SQL | records.ORACLE_SQL | recordings.ORACLE_SQL
