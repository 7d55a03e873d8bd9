"""Queries of the transcript and timing operators over the driver's tables, with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

PLANS = ("timing_queries", "evaluation_queries", "text_queries", "merge_queries", "language_queries", "model_queries", "learning_queries", "source_queries", "column_queries")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _plan in PLANS:
    _module = import_module(f"parlance.plans.{_plan}")
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
