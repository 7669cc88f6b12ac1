"""Centroid clustering of quantised vectors: Lloyd's rounds on distinct vectors with multiplicities, in whole numbers."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import bounded_batches, cut
from strandloom.llm.vectors import usable
from strandloom.operators.joins import heavy_split_join
from strandloom.session import materialize, scratch


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's nearest centroid (the smaller one of two as near) and its squared distance, as whole numbers."""
    far = np.empty((len(rows), len(centroids)), np.int64)
    for j, c in enumerate(centroids):
        far[:, j] = ((rows - c) ** 2).sum(axis=1)
    best = far.argmin(axis=1)
    return best, far[np.arange(len(rows)), best]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, dim)


def _moved(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: every non-empty centroid becomes the floor of the weighted mean of its vectors.

    A task adds up whole numbers for each (centroid, component) and the weights; what comes to the driver is one row for
    each of these, whatever the number of vectors.
    """
    k, dim = centroids.shape

    def add(batches):
        total = np.zeros((k, dim + 1), np.int64)
        for b in cut(batches, 4096):
            rows, n = _matrix(b.column("v"), dim), b.column("n").to_numpy()
            to, _ = nearest(rows, centroids)
            np.add.at(total[:, :dim], to, rows * n[:, None])
            np.add.at(total[:, dim], to, n)
        j, d = np.nonzero(np.broadcast_to(total[:, dim:] > 0, total.shape))
        yield pa.RecordBatch.from_arrays([pa.array(j, pa.int32()), pa.array(d, pa.int32()), pa.array(total[j, d], pa.int64())], names=["j", "d", "s"])

    sums = distinct.select("v", "n").mapInArrow(add, "j int, d int, s long").groupBy("j", "d").agg(F.sum("s").alias("s")).collect()
    total = {(r["j"], r["d"]): r["s"] for r in sums}
    moved = centroids.copy()
    for j in range(k):
        if n := total.get((j, dim)):
            moved[j] = [total[j, d] // n for d in range(dim)]  # floor, for negative sums too
    return moved


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, salt: str = "3:", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector with ``dim`` finite components.

    Components count as ``floor(scale * x)``. Rows with equal whole numbers are one vector with a multiplicity; only these
    distinct vectors, written once, go through the rounds, and the assignments are joined back by a 128-bit key, through the
    heavy split, so that a vector with any number of copies is neither gathered nor computed twice. The first centroids are
    the ``k`` rows with the smallest SHA-256 of salt and id (equal ids: by their components), fewer where there are fewer
    rows; a round that moves nothing ends the rounds, since all others would do the same. All sums are whole numbers, so the
    result depends neither on partitions nor on their order.

    Vectors that are null, have another length, or hold null or non-finite components are left out. A null id counts as the
    text ``null``; rows with equal ids are vectors of their own; an empty table gives an empty result; other columns are left
    out. Components so large that squares or sums don't fit 64 bits raise a ValueError.
    """
    bounded_batches(vectors.sparkSession)
    with scratch(vectors.sparkSession):
        return _clustered(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x")), k, rounds, dim, scale, salt)


def _clustered(rows: DataFrame, k: int, rounds: int, dim: int, scale: int, salt: str) -> DataFrame:
    spark = rows.sparkSession
    rows = rows.where(usable(F.col("x")) & (F.size("x") == dim)).select("vec_id", F.transform("x", lambda x: F.floor(x * scale).cast("long")).alias("v"))
    keyed = rows.withColumn("key", F.concat_ws("-", F.hex(F.xxhash64("v")), F.hex(F.xxhash64(F.lit(1), "v"))))
    distinct = materialize(keyed.groupBy("key", "v").agg(F.count("*").alias("n")), "km-distinct")
    size = F.greatest(F.array_max("v").cast("double"), -F.array_min("v").cast("double"))
    told = distinct.agg(F.max(size).alias("top"), F.sum("n").alias("n")).first()
    total, top = told["n"] or 0, told["top"] or 0.0
    if (2 * top + 1) ** 2 * dim >= 2.0**63 or top * total >= 2.0**62:
        raise ValueError(f"components of up to {top:.3g} are too large for whole numbers of 64 bits")
    name = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))).cast("binary"), 256)
    first = keyed.select(name.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    centroids = np.array([r["v"] for r in first], np.int64).reshape(-1, dim)
    for _ in range(rounds if len(first) else 0):
        moved = _moved(distinct, centroids)
        if (moved == centroids).all():
            break
        centroids = moved

    def assign(batches):
        for b in cut(batches, 4096):
            to, far = nearest(_matrix(b.column("v"), dim), centroids)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("n"), pa.array(to, pa.int32()), pa.array(far, pa.int64())], names=["key", "n", "cluster", "distance"])

    told = materialize(distinct.select("key", "v", "n").mapInArrow(assign, "key string, n long, cluster int, distance long"), "km-told", keep=True)
    inertia = {r["cluster"]: int(r["s"]) for r in told.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)") * F.col("n")).alias("s")).collect()}
    if sum(inertia.values()) >= 1 << 63:
        raise ValueError("the inertia doesn't fit 64 bits")
    shas = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    about = [(j, s, sum(inertia.values()), shas[j]) for j, s in inertia.items()]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = heavy_split_join(keyed.select("vec_id", "key"), told, "key", "n", total)
    return out.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # about: k rows
