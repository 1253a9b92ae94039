"""All registered queries of the library and their SQL."""

from __future__ import annotations

from .plans import queries_compare, queries_entry, queries_live, queries_room, queries_session, queries_sources

_PARTS = [queries_entry, queries_room, queries_session, queries_compare, queries_sources, queries_live]


def queries() -> dict:
    return {k: f for part in _PARTS for k, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for part in _PARTS for k, s in part.ORACLES.items()}
