"""All registered queries of the reference's operators, with their oracle SQL."""

from __future__ import annotations

from motionspark.jobs import group_queries, motion_queries, movie_queries, trace_queries

MODULES = (motion_queries, group_queries, trace_queries, movie_queries)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
