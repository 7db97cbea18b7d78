"""All queries over the driver's tables and their SQL twins, by name."""

from __future__ import annotations

from shelfspark.queries import catalog_queries, ingest_queries, page_queries, relational_queries, search_queries, shelf_queries, text_queries

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (text_queries, relational_queries, catalog_queries, shelf_queries, search_queries, page_queries, ingest_queries):
    for _name, (_run, _sql) in _module.ALL.items():
        QUERIES[_name] = _run
        if _sql:
            ORACLES[_name] = _sql
