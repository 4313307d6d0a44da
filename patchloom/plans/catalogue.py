"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ["findings", "diffs", "indexing", "texts", "scoring", "streams", "references"]


def _merged(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(import_module(f"{__package__}.{name}"), what)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("SQL")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of every review over its merged findings."""
    return queries()["merged_verdict"](spark, sf_dir)
