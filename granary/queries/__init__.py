"""Queries by family, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def put(f: Callable) -> Callable:
            self.queries[name] = f
            if sql:
                self.oracles[name] = sql
            return f

        return put
