"""All queries of the fact engine, and their SQL."""

from __future__ import annotations

from factloom.plans import store_queries, table_queries

_ALL = store_queries.QUERIES | table_queries.QUERIES

QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLES = {name: sql for name, (_, sql) in _ALL.items() if sql is not None}
