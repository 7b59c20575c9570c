"""Every reference-style query by name, with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import core, extraction, log, streams  # noqa: F401  the others register their queries with core

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return dict(core.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(core.ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.QUERIES["r04_insider_radar"](spark, sf_dir)
