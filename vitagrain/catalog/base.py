"""Registration of queries with their checking SQL."""

from __future__ import annotations


class Catalog:
    def __init__(self):
        self.queries = {}
        self.oracles = {}

    def query(self, name: str, sql: str | None = None):
        def register(fn):
            self.queries[name] = fn
            if sql:
                self.oracles[name] = sql
            return fn
        return register
