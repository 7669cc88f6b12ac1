"""Joins that hold up when one key has a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key counts as heavy from this share of all rows, and this many; so there are at most ``1 / HEAVY_SHARE`` heavy keys.
HEAVY_SHARE, HEAVY_ROWS = 1 / 1024, 256


def heavy_from(total: int, share: float = HEAVY_SHARE) -> int:
    """The number of rows from which on a key counts as heavy in a table of ``total`` rows."""
    return max(HEAVY_ROWS, int(total * share))


def heavy_split_join(rows: DataFrame, unique: DataFrame, key: str, weight: str, total: int, share: float = HEAVY_SHARE) -> DataFrame:
    """Left join of ``rows`` with ``unique`` (one row per key; ``weight`` is the number of ``rows`` with that key).

    Keys with at least ``share * total`` (and ``HEAVY_ROWS``) rows go to a broadcast table, which can't have more than
    ``1 / share`` rows; no key of the rest, which is joined by a shuffle, has as many. Where there is no such key, which is
    looked up first, it is one plain join. Null keys match nothing and stay.
    """
    floor = heavy_from(total, share)
    cols = [c for c in unique.columns if c != key]
    if total < floor or unique.where(F.col(weight) >= floor).isEmpty():
        return rows.join(unique, key, "left").select(*rows.columns, *cols)
    heavy = unique.where(F.col(weight) >= floor).withColumn("_hit", F.lit(True))
    light = unique.where(F.col(weight) < floor)
    marked = rows.join(F.broadcast(heavy), key, "left")
    done = marked.where("_hit").select(*rows.columns, *cols)
    rest = marked.where("_hit is null").select(*rows.columns).join(light, key, "left").select(*rows.columns, *cols)
    return done.unionByName(rest)


def salted_join(rows: DataFrame, unique: DataFrame, key: str, weight: str, total: int, block: int = 1024) -> DataFrame:
    """Inner join of ``rows`` with ``unique`` (one row per key, of any width; ``weight`` is about the number of ``rows`` with it).

    A key with more than ``block`` rows is dealt over as many salts as it has blocks, and its row of ``unique`` is repeated for
    each of them: nothing wide is broadcast, and no task gets much more than a block of one key. What is looked up first,
    through the heavy split, is the weight alone. ``weight`` isn't in the result.
    """
    salts = F.ceil(F.col("_w") / block).cast("int")
    weights = unique.select(key, F.col(weight).alias("_w"))
    dealt = heavy_split_join(rows, weights, key, "_w", total).where(F.col("_w").isNotNull())
    dealt = dealt.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), salts).cast("int")).drop("_w")
    wide = unique.withColumn("_w", F.greatest(F.lit(1), F.col(weight))).drop(weight)
    wide = wide.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_w")
    return dealt.join(wide, [key, "_salt"]).drop("_salt")
