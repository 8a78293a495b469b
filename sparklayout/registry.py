"""All registered layout queries and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
MODULES = ("geometry_queries", "netlist_queries", "analytics_queries", "trace_queries", "extract_queries")


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) under ``name``, with its DuckDB SQL where there is one."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return keep


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"sparklayout.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
