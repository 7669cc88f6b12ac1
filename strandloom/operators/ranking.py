"""Dense ids over any number of keys without sorting them in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.session import materialize


def dense_ids(keys: DataFrame, order: list[str], name: str = "no") -> DataFrame:
    """``name``: the rank from 1 of each row of distinct keys in the order of the columns ``order``.

    Rows are dealt out by range and written, so that partitions hold still; each is ranked on its own and moved up by the
    rows of the partitions before it, a table with one row per partition.
    """
    dealt = materialize(keys.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_own", own).join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_part", "_own", "_before")
