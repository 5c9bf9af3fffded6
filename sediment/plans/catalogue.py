"""All queries outside the llm subpackage, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sediment.plans import reference, training


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(reference.QUERIES) | training.QUERIES


def oracle_sql() -> dict[str, str]:
    return dict(reference.ORACLE) | training.ORACLE
