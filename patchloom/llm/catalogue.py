"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from . import queries_credentials, queries_handwritten, queries_overlap, queries_packing, queries_splitting, queries_topn

MODULES = [queries_handwritten, queries_splitting, queries_credentials, queries_topn, queries_packing, queries_overlap]


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
