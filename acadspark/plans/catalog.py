"""The query catalogue: one Spark plan per operator, each with a DuckDB oracle.

Every query reads whole harness tables (or tables Spark derives from them in
``plans.fixtures``). The oracle SQL repeats the derivation in plain SQL, so a
row-count + value comparison checks the Spark operator end to end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import Tables

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, tables)`` under ``name`` with its oracle SQL (None = no oracle)."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(spark, Tables(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        REGISTRY[name] = (run, sql)
        return fn
    return deco


def queries() -> dict[str, Query]:
    _load()
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}


def _load():
    # importing the modules registers their queries
    from . import q_contracts, q_ingest, q_quality, q_timetable, q_enrolment, q_stream  # noqa: F401
