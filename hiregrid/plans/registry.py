"""Registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import health_queries, operator_queries, source_queries  # noqa: F401  their queries register themselves
from .queries import QUERIES, SQL

FLAGSHIP = "source_pair_baselines"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
