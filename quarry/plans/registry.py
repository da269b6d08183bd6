"""Collects the queries and their DuckDB counterparts from the family modules of this package."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FAMILIES: tuple[str, ...] = ("relational", "sync", "retrieval", "graphs", "documents", "lexical", "composites", "search", "records", "stateful")


def _modules():
    return [importlib.import_module(f"quarry.plans.{name}") for name in FAMILIES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _modules() for k, v in m.ORACLES.items()}
