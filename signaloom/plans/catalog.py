"""Registry of the signal queries: name -> (callable, DuckDB SQL)."""

from __future__ import annotations

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def register(name, function, sql=None):
    _QUERIES[name] = function
    if sql:
        _SQL[name] = sql


def _load():
    from . import extra_queries, fitting_queries, more_queries, signal_queries, space_queries  # noqa: F401  they register themselves


def queries():
    _load()
    return dict(_QUERIES)


def oracle_sql():
    _load()
    return dict(_SQL)
