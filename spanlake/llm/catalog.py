"""Registry of this subpackage's queries."""

from __future__ import annotations

from spanlake.plans.catalog import Query, QueryFn

QUERIES: dict[str, Query] = {}


def query(sql: str | None = None):
    """Registers a function under its own name."""

    def register(fn: QueryFn) -> QueryFn:
        QUERIES[fn.__name__] = Query(fn.__name__, (), fn, sql)
        return fn

    return register


def load_all() -> dict[str, Query]:
    from spanlake.llm import queries  # noqa: F401

    return QUERIES
