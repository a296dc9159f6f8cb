"""All queries of the library, by name, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import assoc_queries, evaluation_queries, relational_queries, source_queries, state_queries, text_queries, trend_queries  # noqa: F401
from .registry import QUERIES, SQL, Query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that emerge or decline, with each source's growth taken out."""
    return trend_queries.normalised_emergence(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
