"""Session helpers: a session for tests, the shared folder, and lineage cuts that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_TMP: dict[str, str] = {}
#: Tables to remove, one list for each ``scratch`` that is open.
_OPEN: list[list[str]] = []


def local_session(cores: int = 8, partitions: int = 8, name: str = "strandloom") -> SparkSession:
    """A local session for tests and the bench; on a cluster the session comes from spark-submit."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local master gets one temporary folder for the session, and any other master the warehouse,
    which is shared too. A machine-local folder is never used on a cluster.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_strandloom"
    if sc.applicationId not in _LOCAL_TMP:
        _LOCAL_TMP[sc.applicationId] = tempfile.mkdtemp(prefix="strandloom-")
    return _LOCAL_TMP[sc.applicationId]


def new_path(spark: SparkSession, tag: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/strandloom/{tag}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialize`` writes within are removed at the end, but for those written with ``keep``: these, which the
    result still reads, go with the scratch around this one, or stay."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            remove(spark, path)


def materialize(df: DataFrame, tag: str = "t", keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: a lineage cut that outlives any executor.

    Zstandard works on streams; the default codec holds whole pages, which long values make large, outside the heap.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    levels = _OPEN[:-1] if keep else _OPEN
    if levels:
        levels[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores where it has fewer partitions than that: for work that costs far more than a shuffle."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
