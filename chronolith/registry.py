"""All queries of the history engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from .plans.relations import oracle

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable], Callable]:
    """Registers a query (spark, sf_dir) -> DataFrame under its function's name."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = oracle(sql)
        return f

    return register


from .queries import content, graph, messages, more, references, streams  # noqa: E402,F401  they register themselves
