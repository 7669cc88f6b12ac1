"""Pairs of sets within a group: equal sets are one with a count, so copies are never compared one by one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import seq
from strandloom.session import materialize


def _jaccard(a: str, b: str):
    return F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), seq.jaccard(a, b))


def _weighted(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, j, w): how many pairs of rows of a group have which Jaccard index."""
    own = rows.groupBy(*by, "k").agg(F.count("*").alias("n")).withColumn("no", F.monotonically_increasing_id())
    own = materialize(own, "distinct-sets")
    a, b = (own.select(*by, *(F.col(c).alias(f"{c}{x}") for c in ("no", "k", "n"))) for x in "ab")
    pairs = a.join(b, by).where("noa <= nob")
    weight = F.when(F.col("noa") == F.col("nob"), F.expr("na * (na - 1) div 2")).otherwise(F.col("na") * F.col("nb"))
    told = pairs.select(*by, _jaccard("ka", "kb").alias("j"), weight.alias("w")).where("w > 0")
    return told.groupBy(*by, "j").agg(F.sum("w").alias("w"))


def pair_medians(rows: DataFrame, by: str, key: str, items: str) -> DataFrame:
    """(by, median, n_pairs): the exact median of the Jaccard index over all pairs of rows of a group with different keys.

    ``items`` are sorted arrays of distinct items. Each distinct set stands for its rows: two sets for the product of their
    counts, a set with itself for its n * (n - 1) / 2 pairs; pairs of rows with equal keys are counted and taken off. Null
    items have pairs without a value; rows whose group or key is null have none.
    """
    rows = rows.where(F.col(by).isNotNull() & F.col(key).isNotNull()).select(F.col(by).alias("by_"), F.col(key).alias("key_"), F.col(items).alias("k"))
    again = rows.groupBy("by_", "key_").agg(F.count("*").alias("n")).where("n > 1").select("by_", "key_")
    less = _weighted(rows.join(again, ["by_", "key_"], "left_semi"), ["by_", "key_"]).select("by_", "j", (-F.col("w")).alias("w"))
    told = _weighted(rows, ["by_"]).unionByName(less).groupBy("by_", "j").agg(F.sum("w").alias("w")).where("w > 0")
    return told.groupBy(F.col("by_").alias(by)).agg(F.percentile("j", F.lit(0.5), F.col("w")).alias("median"), F.sum("w").alias("n_pairs"))


def pair_scores(rows: DataFrame, by: list[str], key: str, items: str, items_of: Callable[[str], Column] = F.col, finish: Callable[[str], Column] = F.col, block: int = 64, part: int = 1024) -> DataFrame:
    """(a, b, jaccard, containment) of all pairs of rows of a group, a < b by ``key``; ``finish`` of a score's name is what is returned.

    ``items`` are sorted arrays of distinct items, or what ``items_of`` makes them of; rows with the same are one, and their set is
    made once. A group's sets are dealt into blocks of about ``block``, which meet in cells. Their pairs are scored and finished,
    once each, and then get the keys of their rows, ``part`` at a time as arrays: pairs of rows are neither joined nor shuffled.
    """
    own = rows.where(F.col(key).isNotNull()).groupBy(*by, items).agg(F.collect_list(key).alias("keys"))
    own = materialize(own.select(*by, items_of(items).alias("k"), "keys", F.monotonically_increasing_id().alias("no")), "set-rows")
    blocks = own.groupBy(*by).agg(F.ceil(F.count("*") / block).cast("int").alias("p"))
    dealt = own.drop("keys").join(blocks, by).withColumn("b", F.pmod(F.xxhash64("no"), F.col("p")).cast("int"))
    spark, at = rows.sparkSession, [*by, "i", "j"]
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    one = dealt.select(*by, F.col("b").alias("i"), F.explode(F.sequence("b", F.col("p") - 1)).alias("j"), F.col("no").alias("noa"), F.col("k").alias("ka"))
    two = dealt.select(*by, F.explode(F.sequence(F.lit(0), "b")).alias("i"), F.col("b").alias("j"), F.col("no").alias("nob"), F.col("k").alias("kb"))
    both = one.repartition(tasks, *at).join(two.repartition(tasks, *at), at).where("i < j or noa <= nob")
    scores = both.select("noa", "nob", seq.jaccard("ka", "kb").alias("jaccard"), seq.containment("ka", "kb").alias("containment"))
    scores = materialize(scores.select("noa", "nob", finish("jaccard").alias("jaccard"), finish("containment").alias("containment")), "set-scores")
    parts = F.transform(F.sequence(F.lit(1), F.size("keys"), F.lit(part)), lambda n: F.slice("keys", n, part))
    parts = materialize(own.select("no", F.explode(parts).alias("keys")), "set-keys")
    xs, ys = (parts.select(F.col("no").alias(no), F.col("keys").alias(keys)) for no, keys in (("noa", "xs"), ("nob", "ys")))
    pairs = scores.repartition(tasks, "noa", "nob").join(xs, "noa").join(ys, "nob").withColumn("x", F.explode("xs")).drop("xs").withColumn("y", F.explode("ys"))
    pairs = pairs.where((F.col("x") < F.col("y")) | ((F.col("noa") != F.col("nob")) & (F.col("x") > F.col("y"))))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "jaccard", "containment")
