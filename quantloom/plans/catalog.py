"""Catalogue of queries and oracles of the panel engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quantloom.plans import factors, market, special

_PARTS = [factors, market, special]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for part in _PARTS for k, v in part.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for part in _PARTS for k, v in part.oracle_sql().items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["factors_classic_1"](spark, sf_dir)
