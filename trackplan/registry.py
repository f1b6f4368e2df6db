"""All registered queries of the engine's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import catalog, documents, files, queues, records, sequences, slots, streams, texts, timelines  # noqa: F401


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return queues.quality_tier(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalog.SQL)
