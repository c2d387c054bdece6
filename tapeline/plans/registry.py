"""All registered queries of the recording operators, by name, and their SQL."""

from __future__ import annotations

from tapeline.plans import block_queries, catalog_queries, file_queries, record_queries, timeline_queries

_MODULES = (timeline_queries, catalog_queries, record_queries, file_queries, block_queries)
QUERIES = {f.__name__: f for m in _MODULES for f in m.QUERIES_SQL}
SQL = {f.__name__: sql for m in _MODULES for f, sql in m.QUERIES_SQL.items() if sql}
