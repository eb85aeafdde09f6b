"""All queries of the extraction engine by name."""

from __future__ import annotations

from pagequern.plans import page_extract, page_sql, page_streams

QUERIES = {**page_sql.QUERIES, **page_extract.QUERIES, **page_streams.QUERIES}
ORACLE_SQL = {**page_sql.ORACLE_SQL, **page_extract.ORACLE_SQL, **page_streams.ORACLE_SQL}
