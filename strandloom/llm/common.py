"""What several operators of this subpackage share."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch, and rows of it that are turned into Python objects at a time.
BATCH_BYTES, BATCH_ROWS = 2 << 20, 1000


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's bound on the bytes of an Arrow batch to 2 MB where it is higher (64 MB by default): four copies of
    a batch, in the JVM and in Python, are held for each task. Results that are computed later need it, so it stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(key).rstrip("bB"))
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def cut(batches, rows: int = BATCH_ROWS):
    """Arrow batches of at most ``rows`` rows."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, by Spark's own reader (the folder can be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id", folds: int = 3, fold: int = 1):
    """Whether ``crc32(doc_id as text) mod folds`` is ``fold``; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def drawn(rows: DataFrame, key: str, wanted: dict, found: dict) -> DataFrame:
    """``wanted[v]`` rows of each value v of ``key`` and a few more (none where there are fewer), by their smallest ``draw``.

    ``draw`` is a 64-bit hash, so length and order have no part in it. ``found`` is the number of rows of each value: a share
    of a little over what is wanted is cut off, by a broadcast table of the values; nothing is ranked or gathered.
    """
    space, low = 1 << 64, -(1 << 63)
    more = {v: int(n) + 4 * math.isqrt(int(n)) + 10 for v, n in wanted.items()}
    ends = [(v, min((1 << 63) - 1, low + space * n // max(1, found[v]))) for v, n in more.items() if found.get(v)]
    plan = rows.sparkSession.createDataFrame(ends, f"`{key}` {rows.schema[key].dataType.simpleString()}, last long")
    near = rows.join(F.broadcast(plan), key).where(F.col("draw") <= F.col("last")).drop("last")
    return near.dropDuplicates([key, "draw"])


def within(sample: DataFrame, key: str, cells: int) -> DataFrame:
    """The rows of a bounded written table that keep the ``cells`` of each value of ``key`` to about that number, by ``draw``.

    Of a value with more, the first rows by ``draw`` stay, as large a part of their range as the cells allow, and one at least.
    """
    told = sample.groupBy(key).agg(F.sum("cells").alias("all_"), F.min("draw").alias("first_"), F.max("draw").alias("last_"))
    far = lambda c: F.col(c).cast("double") - F.col("first_").cast("double")
    stays = (F.col("all_") <= cells) | (far("draw") * F.col("all_") <= far("last_") * cells)
    return sample.join(F.broadcast(told), key).where(stays).drop("all_", "first_", "last_")  # told: one row for each value of a sample


#: Entries of a counter table that travel in one row.
SLICE = 1 << 16
#: Partial tables that are added up in one group.
FAN_IN = 64


def count_table(rows: DataFrame, counts, size: int, kind: str = "int64"):
    """Sum of a fixed-size counter table over all partitions of ``rows``, as an array of ``kind`` on the driver.

    ``counts(batches)`` takes a partition's Arrow batches and returns its table (``kind``, ``size`` entries). Tables are cut
    into slices and added up in a tree of fan-in ``FAN_IN``; what reaches the driver has ``size`` entries whatever the input.
    """
    import zlib
    from functools import reduce

    import numpy as np
    import pandas as pd
    import pyarrow as pa

    def run(batches):
        from pyspark import TaskContext

        total = np.asarray(counts(batches), kind)
        part = TaskContext.get().partitionId()
        for k in range(0, size, SLICE):
            piece = total[k : k + SLICE]
            if piece.any():
                yield pa.RecordBatch.from_arrays([pa.array([k // SLICE], pa.int64()), pa.array([part], pa.int64()), pa.array([zlib.compress(piece.tobytes(), 1)], pa.binary())], names=["slice", "part", "data"])

    def add(key, pdf):
        return pd.DataFrame({"slice": [key[0]], "part": [key[1]], "data": [zlib.compress(reduce(np.add, (np.frombuffer(zlib.decompress(d), kind) for d in pdf["data"])).tobytes(), 1)]})

    schema, left = "slice long, part long, data binary", rows.rdd.getNumPartitions()
    out = rows.mapInArrow(run, schema)
    while True:
        out = out.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("slice", "part").applyInPandas(add, schema)
        left = -(-left // FAN_IN)
        if left <= 1:
            break
    total = np.zeros(size, kind)
    for r in out.collect():
        piece = np.frombuffer(zlib.decompress(r["data"]), kind)
        total[r["slice"] * SLICE : r["slice"] * SLICE + len(piece)] += piece
    return total
