"""Shared by the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import seq

#: ``dna(text)`` in DuckDB.
DNA = "translate(lower(regexp_replace({0}, '[^A-Za-z]', '', 'g')), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"
#: ``revcomp(x)`` in DuckDB.
RC = "reverse(translate({0}, 'ACGTacgtNn', 'TGCAtgcaNn'))"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: Column | str) -> Column:
    return F.unix_timestamp(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def long(c: Column | str) -> Column:
    return seq.col(c).cast("long")


def r6(c: Column | str) -> Column:
    """Six digits, rounded as DuckDB does: the product with 10**6, not the shortest decimal, decides at a half."""
    return F.round(seq.col(c).cast("double") * 1e6) / 1e6


class Book:
    """Collects the queries of a module and their SQL."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def keep(f):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return keep
