"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import (
    compare_queries,
    flagship,
    latency_queries,
    live_queries,
    resource_queries,
    streaming_queries,
    transform_queries,
)

_AREAS = (flagship, transform_queries, streaming_queries, latency_queries, live_queries, resource_queries,
          compare_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for area in _AREAS for name, query in area.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for area in _AREAS for name, sql in area.ORACLES.items()}
