"""Queries of the library's own operators, each beside the DuckDB SQL with the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules of this package; each has QUERIES (name -> callable) and SQL (name -> text).
MODULES = ("relational", "intervals", "sequences", "verdicts", "bags", "graphs", "parsers", "placement", "nulls", "evidence", "families", "registered")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"{__name__}.{m}").SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["q_bag_flagship"](spark, sf_dir)
