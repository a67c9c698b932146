"""Collects the registered queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

MODULES = ["roles_check", "parsing", "metrics", "movement", "quality", "cost", "timeliness", "riders", "feedback", "safety", "cross", "actions", "cited"]


class Book:
    """Named queries with their SQL, kept side by side in the module that defines them."""

    def __init__(self) -> None:
        self.queries: dict[str, QueryFn] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, fn: QueryFn, sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"query {name} registered twice")
        self.queries[name] = fn
        if sql is not None:
            self.sql[name] = sql

    def query(self, name: str, sql: str | None = None):
        def keep(fn: QueryFn) -> QueryFn:
            self.add(name, fn, sql)
            return fn

        return keep


def load() -> Book:
    merged = Book()
    for module in MODULES:
        book = import_module(f"tripscope.plans.{module}").BOOK
        for name, fn in book.queries.items():
            merged.add(name, fn, book.sql.get(name))
    return merged
