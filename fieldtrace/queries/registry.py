"""Registration of queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(function):
            self.queries[function.__name__] = function
            if sql:
                self.sql[function.__name__] = sql
            return function

        return add
