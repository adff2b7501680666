"""Every query of the library by name, with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weft.plans import parts, queries as graph_queries  # noqa: F401  parts registers its own


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic insights: the entities that each topic finds, with their strongest edges."""
    return graph_queries.insights(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(graph_queries.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(graph_queries.ORACLES)
