"""All queries of the library proper and the DuckDB SQL each is checked against."""

from __future__ import annotations

from sluice.plans import document_queries, operation_queries, text_queries

MODULES = (text_queries, document_queries, operation_queries)
QUERIES: dict = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
