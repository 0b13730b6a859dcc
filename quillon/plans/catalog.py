"""Every registered query of the engine's own operators, and the SQL for those that SQL can express."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

MODULES = ("search", "timeline", "corpus", "governance", "recordings", "maintenance", "forms", "changes")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with SQL that gives the same rows where there is such SQL."""

    def register(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered already")
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def load() -> dict[str, Query]:
    """Import the modules that register queries."""
    for name in MODULES:
        importlib.import_module(f"quillon.plans.{name}")
    return QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval: keywords and vectors, fused, reranked and cut."""
    return load()["ret_18_hybrid_search"](spark, sf_dir)
