"""Ready-made queries over the sample tables, each with SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of (spark, folder) under its own name, with its SQL twin if it has one."""
    def register(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn

    return register


def load_all() -> None:
    from plumbline.catalog import checking, comparing, correcting, dating, profiling, ruling, running, scoring, streaming, tracking  # noqa: F401
