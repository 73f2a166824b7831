"""Registry of the query plans: name -> (Spark callable, oracle SQL)."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

PLAN_MODULES = (
    "scans", "filters", "scalars", "series", "joining", "catalogs", "spatial", "aggregating",
    "evaluation", "fuzzy", "rules", "global_cells", "segment_state", "learning", "backtests",
    "rasters", "live",
)


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


_QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a plan under *name*; *sql* is the DuckDB statement with the same result."""

    def register(fn):
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = Query(name, fn, sql)
        return fn

    return register


def load_all() -> dict[str, Query]:
    for module in PLAN_MODULES:
        importlib.import_module(f"riskweave.plans.{module}")
    return dict(_QUERIES)
