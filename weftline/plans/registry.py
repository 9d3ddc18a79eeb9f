"""Queries by operator id, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` may name the derived frames of ``frames.CTES``."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            from .frames import with_frames

            ORACLES[name] = with_frames(sql)
        return f

    return add
