"""Registered queries over the given tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cleaning, distribution, drift, quality, relations, segments, sources, target, text

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = (sources, quality, distribution, relations, target, cleaning, drift, text, segments)


def queries() -> dict[str, Query]:
    return {name: entry[0] for module in _MODULES for name, entry in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {
        name: entry[1] for module in _MODULES for name, entry in module.QUERIES.items() if entry[1] is not None
    }
