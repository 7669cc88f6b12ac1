"""Aggregations with the exact semantics that differ from the built-in ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def index_quantile(value: Column | str, p: float) -> Column:
    """The element at ``floor(n * p)`` of the sorted values (no interpolation, not ``percentile_disc``); nulls are left out."""
    v = F.array_sort(F.collect_list(value))
    return F.when(F.size(v) > 0, F.get(v, F.least(F.size(v) - 1, F.floor(F.size(v) * p).cast("int"))))


def ranked_quantile(df: DataFrame, by: list[str], value: str, p: float, name: str = "q") -> DataFrame:
    """The same for groups of any size: ranks by window, no list in memory."""
    v = df.where(F.col(value).isNotNull())
    order = Window.partitionBy(*by).orderBy(value)
    at = F.least(F.col("_n") - 1, F.floor(F.col("_n") * p)) + 1
    v = v.withColumn("_r", F.row_number().over(order)).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    return v.where(F.col("_r") == at).select(*by, F.col(value).alias(name))


def mode(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Most frequent value of each group, ties to the smaller: counts, then one row per group."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(F.min_by(F.struct(F.col(value).alias("value"), "n"), F.struct(-F.col("n"), F.col(value))).alias("m")).select(*by, F.col("m.value").alias("mode"), F.col("m.n").alias("n"))


def n50(df: DataFrame, by: list[str], length: str) -> DataFrame:
    """(by, n, total, n50): the length at which the longest items reach half of the total."""
    order = Window.partitionBy(*by).orderBy(F.desc(length))
    run = df.withColumn("_sum", F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum(length).over(Window.partitionBy(*by)))
    return run.groupBy(*by).agg(F.count("*").alias("n"), F.sum(length).alias("total"), F.max(F.when(F.col("_sum") * 2 >= F.col("_all"), F.col(length))).alias("n50"))


def median_mad(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, median, mad): the interpolated median and the median absolute deviation from it, in two passes."""
    mid = df.groupBy(*by).agg(F.median(value).alias("median"))
    return df.join(mid, by).groupBy(*by).agg(F.first("median").alias("median"), F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))


def draw(*keys: Column | str) -> Column:
    """A reproducible random number in [0, 1) from keys: the same on every engine with MD5."""
    text = F.concat_ws("|", *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def rarefaction(df: DataFrame, unit: str, item: str, steps: list[int], reps: int, seed: int) -> DataFrame:
    """(n_units, mean_items): mean number of distinct items in random subsets of units, over ``reps`` orders of the units.

    An item is seen from the smallest rank of its units on, so one aggregate gives every step at once: no subset is joined.
    """
    order = Window.partitionBy("rep").orderBy("_d", unit)
    units = df.select(unit).distinct().withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    units = units.withColumn("_d", draw(F.lit(seed), F.col("rep"), F.col(unit))).withColumn("rank", F.row_number().over(order))
    seen = df.select(unit, item).distinct().join(units, unit).groupBy("rep", item).agg(F.min("rank").alias("from"))
    wide = seen.withColumn("n_units", F.explode(F.array(*map(F.lit, steps)))).where("from <= n_units")
    per = wide.groupBy("rep", "n_units").agg(F.count("*").alias("items"))
    return per.groupBy("n_units").agg((F.sum("items") / reps).alias("mean_items"))


def seed_sample(eligible: DataFrame, item: str, n: int, seed: int, include: DataFrame | None = None, exclude: DataFrame | None = None, suffix: str = ".fna") -> DataFrame:
    """ST8: the first ``n`` of the eligible items in a seeded order: (item, place).

    ``include`` and ``exclude`` are pools (one column of names, with or without ``suffix``): only items of the one, and none of
    the other, are drawn. A pool that leaves none of the items there are is an error: the names don't match. The order is a
    hash of seed and item, so it is the same whatever the partitions; the first ``n`` are taken without a full sort.
    """
    from strandloom.operators.gates import GateError

    def named(pool: DataFrame) -> DataFrame:
        name = F.col(pool.columns[0]).cast("string")
        return pool.select(F.when(F.endswith(name, F.lit(suffix)), F.substring(name, F.lit(1), F.length(name) - len(suffix))).otherwise(name).alias("_name")).distinct()

    rows = eligible.select(item).distinct().withColumn("_name", F.col(item).cast("string"))
    kept = rows.join(named(include), "_name", "left_semi") if include is not None else rows
    if include is not None and kept.isEmpty() and not rows.isEmpty():
        raise GateError("the pool has no eligible item: its names don't match")
    kept = kept.join(named(exclude), "_name", "left_anti") if exclude is not None else kept
    first = kept.withColumn("_draw", draw(F.lit(seed), F.col(item))).orderBy("_draw", item).limit(n)
    return first.withColumn("place", F.row_number().over(Window.orderBy("_draw", item))).select(item, "place")  # n rows
