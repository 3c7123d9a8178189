"""All named queries and their SQL, gathered from the plan modules."""

from __future__ import annotations

from . import profile_queries, score_queries, select_queries, source_queries


def _modules():
    return (profile_queries, select_queries, score_queries, source_queries)


def queries() -> dict:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in _modules() for k, v in m.ORACLE_SQL.items()}
