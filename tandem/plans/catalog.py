"""All queries on the star-schema tables, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from . import analysis_queries, event_queries, network_queries, source_queries

_PARTS = (event_queries, network_queries, analysis_queries, source_queries)


def queries() -> dict[str, Callable]:
    return {name: f for part in _PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.oracles().items()}
