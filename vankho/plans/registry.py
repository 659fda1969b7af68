"""Registration of queries and their SQL by decorator."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict, dict, Callable]:
    """(queries, sql, decorator): the decorator registers a function under its name, with its SQL where there is one."""
    queries: dict = {}
    sql: dict[str, str] = {}

    def query(text: str | None = None) -> Callable:
        def register(f: Callable) -> Callable:
            queries[f.__name__] = f
            if text:
                sql[f.__name__] = text
            return f

        return register

    return queries, sql, query
