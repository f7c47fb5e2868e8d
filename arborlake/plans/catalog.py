"""Every registered query over the driver tables, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import catalog_code, catalog_extra, catalog_forest, catalog_more, catalog_ordered, catalog_store

PARTS = [catalog_forest, catalog_more, catalog_extra, catalog_code, catalog_ordered, catalog_store]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for part in PARTS for k, v in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for part in PARTS for k, v in part.ORACLES.items()}
