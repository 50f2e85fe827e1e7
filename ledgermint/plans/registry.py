"""The registered queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import model_queries  # noqa: F401  registers its queries
from .queries import QUERIES, SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All transactions routed, by template, method and category."""
    return QUERIES["c12_route"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
