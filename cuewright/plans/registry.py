"""All registered queries of the reference's operators, gathered from the adapter modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import catalogue, records, signal

_MODULES = (signal, catalogue, records)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["cut_runs"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
