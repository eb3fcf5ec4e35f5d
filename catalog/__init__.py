"""Queries over the shared tables, each next to the SQL that must give the same rows."""

from __future__ import annotations

from catalog import climate, columns, events, io, models, quality, statistics, streams

MODULES = [climate, columns, statistics, events, quality, io, streams, models]


def all_queries() -> dict:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
