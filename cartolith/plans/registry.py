"""All registered queries of the library and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES: tuple[str, ...] = ("tag_queries", "cell_queries", "feature_queries", "raster_queries", "stream_queries", "network_queries", "source_queries", "terrain_queries", "area_queries", "road_queries", "ring_queries", "asset_queries", "job_queries", "fitting_queries")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in MODULES:
        found |= import_module(f"cartolith.plans.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found |= import_module(f"cartolith.plans.{name}").SQL
    return found
