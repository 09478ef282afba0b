"""Registered queries by name, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Register a query function under ``name``, with its SQL where there is one."""

    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def load() -> None:
    """Import the modules that register queries."""
    from factloom.plans import answers, decisions, facts, grounding, matching, measures, pages, people, reading, records, streams, texts, views  # noqa: F401



