"""The registered queries and their SQL."""

from __future__ import annotations

from . import star_queries, state_queries, text_queries

TABLES = (star_queries.QUERIES, text_queries.QUERIES, state_queries.QUERIES)


def queries() -> dict:
    return {name: run for table in TABLES for name, (run, _) in table.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for table in TABLES for name, (_, sql) in table.items() if sql}
