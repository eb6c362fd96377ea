"""Queries by name, their DuckDB twins, and the operators of the survey that each covers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(covers: str, oracle: str | None = None):
    """Registers a function as the query of its name."""

    def wrap(f):
        QUERIES[f.__name__] = f
        COVERS[f.__name__] = covers
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return wrap
