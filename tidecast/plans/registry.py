"""Query registry: ``name -> (spark builder, DuckDB oracle SQL or None)``.

Keys follow the survey ids: ``<id>_<name>`` in lower case.  Every builder takes
``(spark, sf_dir)`` and reads the driver tables under ``sf_dir``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query builder (and its oracle SQL when it has one)."""

    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def load_all() -> None:
    """Import every query module so that its registrations run."""
    from . import q_dated, q_decisions, q_dist, q_ensemble, q_forecasts, q_io, q_models, q_panel, q_scores, q_tables  # noqa: F401
