"""All queries of the quality-control engine and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lamina.plans import assign_queries, baseline_queries, grid_queries, image_queries, nested_queries, raster_queries, report_queries, shape_queries, source_queries, validate_queries

Query = Callable[[SparkSession, str], DataFrame]
MODULES = [baseline_queries, assign_queries, validate_queries, nested_queries, grid_queries, source_queries, image_queries, raster_queries, shape_queries, report_queries]


def queries() -> dict[str, Query]:
    return {name: q for m in MODULES for name, q in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.oracle_sql().items()}
