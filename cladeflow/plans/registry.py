"""Queries and their DuckDB equivalents by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str) -> Callable:
    """Adds a query under a name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name], ORACLES[name] = f, oracle
        return f

    return add


def text_of(array: str) -> Column:
    """An array column as comma-joined text."""
    return F.concat_ws(",", F.col(array).cast("array<string>"))
